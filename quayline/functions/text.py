"""Text, key and hash functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rewriting rules of the phonetic key, in order, then single letters, then the letters dropped after the first.
DIGRAPHS = (("PH", "F"), ("GH", "G"), ("KN", "N"), ("WR", "R"), ("QU", "K"), ("CK", "K"), ("CH", "X"), ("SH", "X"), ("TH", "T"))
LETTERS = ("CQZV", "KKSF")
DROPPED = "AEIOUYWH"

# The texts of prompts and training targets.
PROMPT_HEAD = "Candidate vessel names: "
PROMPT_TAIL = ". Use a candidate only if it is spoken."
TARGET_HEAD = "language English<asr_text>"

_TRUE, _FALSE = ("true", "1", "yes", "y"), ("false", "0", "no", "n")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_text(c: Column | str) -> Column:
    """Upper case, with every run of other than ASCII letters and digits as one space, trimmed."""
    return F.trim(F.regexp_replace(F.upper(_col(c)), "[^A-Za-z0-9]+", " "))


def phoneme_key(c: Column | str) -> Column:
    """A rough phonetic key for each word of the normalized text, joined by spaces."""
    spelled = reduce(lambda text, rule: F.replace(text, F.lit(rule[0]), F.lit(rule[1])), DIGRAPHS, normalize_text(c))
    words = F.split(F.translate(spelled, *LETTERS), " ")
    tail = lambda w: F.translate(F.substring(w, 2, 1 << 30), DROPPED, "")
    short = F.transform(words, lambda w: F.regexp_replace(F.concat(F.substring(w, 1, 1), tail(w)), r"(.)\1+", "$1"))
    return F.array_join(short, " ")


def key_letters(key: Column) -> Column:
    """The distinct characters of a phonetic key, spaces aside."""
    return F.array_distinct(F.filter(F.split(F.replace(key, F.lit(" "), F.lit("")), ""), lambda x: x != ""))


def phoneme_similarity(a: Column | str, b: Column | str) -> Column:
    """How many distinct characters the two keys share."""
    return F.size(F.array_intersect(key_letters(phoneme_key(a)), key_letters(phoneme_key(b))))


def load_names(c: Column | str, is_json: bool = False) -> Column:
    """A roster with white space collapsed and blank names dropped, from an array or its JSON text."""
    names = F.from_json(_col(c), "array<string>") if is_json else _col(c)
    clean = F.transform(names, lambda n: F.trim(F.regexp_replace(n, r"(?U)\s+", " ")))
    return F.coalesce(F.filter(clean, lambda n: n != ""), F.array().cast("array<string>"))


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(_col(c), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def family_raw(entities: Column | str) -> Column:
    """Distinct non-empty names as they are, sorted."""
    return F.array_sort(F.array_distinct(F.filter(_col(entities), lambda n: F.coalesce(n, F.lit("")) != "")))


def family_normalized(entities: Column | str) -> Column:
    """Distinct upper-case names without white space at their ends, blanks dropped, sorted."""
    return family_raw(F.transform(_col(entities), lambda n: F.upper(strip(n))))


def generation_shard(path: Column | str) -> Column:
    """The number of the first ``shard_`` part of a path; an error where there is none."""
    found = F.regexp_extract(_col(path), "(?:^|/)shard_([^/]*)", 1)
    missing = F.raise_error(F.concat(F.lit("no shard part in "), _col(path)))
    return F.when(found == "", missing.cast("int")).otherwise(found.cast("int"))


def digest(*parts: Column | str | int) -> Column:
    """SHA-256 of the parts joined by colons; str arguments name columns, other constants stand for themselves."""
    return F.sha2(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.col(p).cast("string") if isinstance(p, str) else F.lit(str(p)) for p in parts]), 256)


def sample_key(seed: int, ident: Column | str) -> Column:
    """The key by which samples are ordered."""
    return digest(seed, ident)


def hash_number(*parts: Column | str | int) -> Column:
    """The first 13 hex digits of ``digest`` as a bigint."""
    return F.conv(F.substring(digest(*parts), 1, 13), 16, 10).cast("bigint")


def uniform(*parts: Column | str | int) -> Column:
    """A keyed number from 0 to below 1, alike wherever and however often it is evaluated."""
    return hash_number(*parts) / F.lit(float(1 << 52))


def hash_order(array: Column, *parts: Column | str | int) -> Column:
    """``array`` in the order of a keyed hash of each element, then of place: a shuffle that can be repeated."""
    keyed = F.transform(array, lambda x, i: F.struct(digest(*parts, x).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def prompt(candidates: Column | str) -> Column:
    """The prompt for a list of names, which may be empty."""
    return F.concat(F.lit(PROMPT_HEAD), F.array_join(_col(candidates), "; "), F.lit(PROMPT_TAIL))


def training_target(c: Column | str) -> Column:
    return F.concat(F.lit(TARGET_HEAD), _col(c))


def clean_name(ident: Column | str) -> Column:
    """A file name with the id in six digits, more if it is longer."""
    return F.format_string("%06d.wav", _col(ident).cast("bigint"))


def scene_name(ident: Column | str, profile: Column | str) -> Column:
    return F.concat(_col(profile), F.lit("/"), F.format_string("%06d_%s.wav", _col(ident).cast("bigint"), _col(profile)))


def parse_bool(value: str | bool) -> bool:
    """True, 1, yes, y or false, 0, no, n in any case; anything else is an error."""
    said = str(value).strip().lower()
    if said not in _TRUE + _FALSE:
        raise ValueError(f"not a boolean: {value!r}")
    return said in _TRUE


def parse_bool_column(c: Column | str) -> Column:
    said = F.lower(strip(c))
    return F.when(said.isin(*_TRUE), True).when(said.isin(*_FALSE), False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), _col(c))).cast("boolean"))


def key_map(names: Column | str) -> Column:
    """Each distinct name with its phonetic key."""
    return F.map_from_entries(F.transform(F.array_distinct(_col(names)), lambda n: F.struct(n, phoneme_key(n))))


def without(names: Column, positives: Column) -> Column:
    """``names`` in order, without those that are a positive once normalized."""
    known = F.transform(positives, normalize_text)
    return F.filter(names, lambda n: ~F.array_contains(known, normalize_text(n)))


def matching(text: Column, names: Column) -> Column:
    """The names, in order and with repeats, that stand as whole words in ``text`` once both are normalized."""
    padded = F.concat(F.lit(" "), normalize_text(text), F.lit(" "))
    return F.filter(names, lambda n: (normalize_text(n) != "") & F.contains(padded, F.concat(F.lit(" "), normalize_text(n), F.lit(" "))))


def phoneme_negatives(names: Column, positives: Column, count: int) -> Column:
    """Up to ``count`` other names that sound most like any positive; descending by (score, key, name)."""
    letters = F.transform(positives, lambda p: key_letters(phoneme_key(p)))
    # each key is made once, then its letters once
    keyed = F.transform(without(names, positives), lambda n: F.struct(n.alias("name"), phoneme_key(n).alias("key")))
    lettered = F.transform(keyed, lambda s: F.struct(s["name"].alias("name"), s["key"].alias("key"), key_letters(s["key"]).alias("letters")))

    def scored(s: Column) -> Column:
        shared = F.transform(letters, lambda own: F.size(F.array_intersect(s["letters"], own)))
        return F.struct(F.coalesce(F.array_max(shared), F.lit(0)).alias("score"), s["key"].alias("key"), s["name"].alias("name"))

    ranked = F.sort_array(F.transform(lettered, scored), asc=False)
    return F.transform(F.slice(ranked, 1, count), lambda s: s["name"])


def random_negatives(names: Column, positives: Column, count: int, *key: Column | str | int) -> Column:
    """Up to ``count`` other names in hash order."""
    return F.slice(hash_order(without(names, positives), *key), 1, count)
