"""Token counts by a unigram model, with forward scores shared along a trie of distinct pre-tokens."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quayline.llm.common import small_batches, within
from quayline.llm.sptokens import MODEL, SPACE, load_model


def log_probabilities(model: dict) -> tuple[dict[str, float], float]:
    """Unigram log probabilities of the normal pieces, Zipf by their rank in the file, and the cost of one byte piece."""
    ranked = sorted(model["pieces"], key=lambda p: model["pieces"][p])
    mass = math.log(sum(1 / (r + 2) for r in range(len(ranked))))
    return {p: -math.log(r + 2) - mass for r, p in enumerate(ranked)}, -math.log(2 * (len(ranked) + 2)) - mass


class Trie:
    """Pre-tokens as paths. A node holds the best score of any segmentation of its prefix and that one's token count."""

    #: Nodes and terminals kept by one task; beyond them the trie starts anew. Longer words are scored apart from it.
    most_nodes, most_words, longest = 400_000, 400_000, 1_000

    def __init__(self, logs: dict[str, float], byte_log: float):
        self.byte_log = byte_log
        # every suffix of a piece, with the piece's log probability if it is one itself
        self.suffixes: dict[str, float | None] = {p[i:]: None for p in logs for i in range(1, len(p))}
        self.suffixes |= logs
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.scores, self.counts = [0.0], [0]
        self.terminals: dict[bytes, int] = {}

    def _forward(self, text: str, end: int, scores: list[float], counts: list[int]) -> tuple[float, int]:
        """Best score and count of text[:end], given those of all shorter prefixes; ties keep the shorter last piece."""
        raw = len(text[end - 1].encode("utf-8", "replace"))
        best, count = scores[end - 1] + raw * self.byte_log, counts[end - 1] + raw
        suffixes = self.suffixes
        for start in range(end - 1, -1, -1):
            log = suffixes.get(text[start:end], 0)
            if log is None:
                continue
            if log == 0:
                break  # no piece ends like this, so no longer one does
            if (score := scores[start] + log) > best:
                best, count = score, counts[start] + 1
        return best, count

    def tokens(self, word: bytes) -> int:
        """The token count of a pre-token, read at its terminal or stored there after one descent."""
        found = self.terminals.get(word)
        if found is not None:
            return found
        text = SPACE + word.decode("utf-8", "replace")
        if len(text) > self.longest:
            scores, counts = [0.0], [0]
            for end in range(1, len(text) + 1):
                score, count = self._forward(text, end, scores, counts)
                scores.append(score)
                counts.append(count)
            return counts[-1]
        if len(self.scores) + len(text) > self.most_nodes or len(self.terminals) >= self.most_words:
            self.clear()
        node, scores, counts = 0, [0.0], [0]
        for end, char in enumerate(text, 1):
            edge = (node << 21) | ord(char)
            node = self.child.get(edge, 0)
            if not node:
                score, count = self._forward(text, end, scores, counts)
                node = self.child[edge] = len(self.scores)
                self.scores.append(score)
                self.counts.append(count)
            scores.append(self.scores[node])
            counts.append(self.counts[node])
        self.terminals[word] = counts[-1]
        return counts[-1]


def count_tokens(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id, n_pretokens and n_tokens of each whole ``text``.

    Pre-tokens are runs of characters other than ASCII white space, each led by the space mark; a pre-token takes the
    tokens of its most likely segmentation, and a character outside the vocabulary one token for each UTF-8 byte.
    Each task inserts its distinct pre-tokens in a bounded trie, so nothing is shuffled. Null and empty texts count 0;
    null and repeated ids and repeated rows are rows like any other; an empty table gives none.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(log_probabilities(load_model(model_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(*shared.value)
        for batch in within(batches):
            words, tokens = [], []
            for text in batch.column("text").to_pylist():
                own = (text or "").encode("utf-8", "replace").split()
                words.append(len(own))
                tokens.append(sum(map(trie.tokens, own)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_pretokens bigint, n_tokens bigint")
