"""DuckDB SQL for the registered queries, written independently of the expressions they check."""

from __future__ import annotations

import cmath
import math

from quayline.functions.profiles import CONTEXT_POLICY, PROFILES

BIAS_TYPES = ("no_bias", "oracle_bias", "noisy_bias", "distractor_bias", "vhf_error")
PRIORITIES = "('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')"


def _h(*parts: str) -> str:
    return f"sha256(concat_ws(':', {', '.join(parts)}))"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(upper(replace({x}, 'ß', 'SS')), '[^A-Za-z0-9]+', ' ', 'g'))"


def _key(x: str) -> str:
    spelled = _norm(x)
    for old, new in (("PH", "F"), ("GH", "G"), ("KN", "N"), ("WR", "R"), ("QU", "K"), ("CK", "K"), ("CH", "X"), ("SH", "X"), ("TH", "T")):
        spelled = f"replace({spelled}, '{old}', '{new}')"
    spelled = f"translate({spelled}, 'CQZV', 'KKSF')"
    short = "substr(w, 1, 1) || regexp_replace(substr(w, 2), '[AEIOUYWH]', '', 'g')"
    once = f"list_reduce(string_split({short}, ''), lambda a, b: CASE WHEN right(a, 1) = b THEN a ELSE a || b END)"
    return f"array_to_string(list_transform(string_split({spelled}, ' '), lambda w: {once}), ' ')"


def _letters(key: str) -> str:
    return f"list_distinct(list_filter(string_split(replace({key}, ' ', ''), ''), lambda x: x <> ''))"


def _prompt(x: str) -> str:
    return f"'Candidate vessel names: ' || array_to_string({x}, '; ') || '. Use a candidate only if it is spoken.'"


def _without(names: str, positives: str) -> str:
    return f"list_filter({names}, lambda n: NOT list_contains(list_transform({positives}, lambda p: {_norm('p')}), {_norm('n')}))"


def _shuffled(names: str, *key: str) -> str:
    return f"list_transform(list_sort(list_transform({names}, lambda n: {_h(*key, 'n')} || n)), lambda s: substr(s, 65))"


_BIAS_CASE = "['" + "','".join(BIAS_TYPES) + "'][id % 5 + 1]"
_MODE = f"CASE {_BIAS_CASE} WHEN 'no_bias' THEN 0 WHEN 'oracle_bias' THEN 1 WHEN 'noisy_bias' THEN 1 ELSE 2 END"
_PAIR = "['no_context_control', 'supported_prompt_consistency', 'unsupported_prompt_invariance'][mode + 1]"

_MANIFEST = """manifest AS (SELECT o_orderkey AS id, o_orderpriority AS profile, o_custkey AS dialogue, o_orderkey % 9 AS shard FROM orders),
families AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS entity FROM lineitem)"""


def _top(source: str, quota: int) -> str:
    rank = f"row_number() OVER (PARTITION BY profile ORDER BY {_h('20260830', 'id')}, id::VARCHAR)"
    return f"(SELECT * FROM (SELECT *, {rank} AS n FROM {source} WHERE profile IN {PRIORITIES}) WHERE n <= {quota})"


_DISCOVERY = f"{_MANIFEST}, pool AS (SELECT * FROM manifest WHERE id IN (SELECT id FROM families)), d_in AS (SELECT * FROM pool WHERE shard BETWEEN 0 AND 3), discovery AS {_top('d_in', 4)}"
_CONFIRMATION = f"""{_DISCOVERY}, c_in AS (SELECT * FROM pool p WHERE shard BETWEEN 4 AND 7
  AND NOT EXISTS (SELECT 1 FROM discovery d WHERE d.dialogue = p.dialogue) AND NOT EXISTS (SELECT 1 FROM discovery d WHERE d.id = p.id)
  AND id NOT IN (SELECT id FROM families WHERE entity IN (SELECT entity FROM families WHERE id IN (SELECT id FROM discovery)))),
confirmation AS {_top('c_in', 4)}"""
_TEST = f"""{_MANIFEST}, train AS {_top('manifest', 2)}, eligible AS (SELECT * FROM manifest m WHERE id IN (SELECT id FROM families)
  AND NOT EXISTS (SELECT 1 FROM train t WHERE t.dialogue = m.dialogue) AND NOT EXISTS (SELECT 1 FROM train t WHERE t.id = m.id)
  AND id NOT IN (SELECT id FROM families WHERE entity IN (SELECT entity FROM families WHERE id IN (SELECT id FROM train)))),
test AS {_top('eligible', 10)}"""

_SAMPLE = f"""sample AS (SELECT * FROM (SELECT *, {_h('20260830', 'doc_id')} AS k, row_number() OVER (PARTITION BY lang ORDER BY {_h('20260830', 'doc_id')}, doc_id::VARCHAR) AS n
  FROM documents WHERE lang IN ('en', 'fr', 'de', 'es')) WHERE n <= 10)"""

_NAMES = """names AS (SELECT l_orderkey AS id, list(p_name || CASE WHEN l_linenumber % 2 = 0 THEN ' ' ELSE '' END) AS names, list_sort(list(DISTINCT p_name)) AS roster
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"""


def _split(holdout: int) -> str:
    pool = f"WHERE g >= {holdout}" if holdout else ""
    cut = "CASE WHEN r < v THEN 'validation' WHEN r < n - t THEN 'test' ELSE 'train' END" if holdout else "CASE WHEN r < t THEN 'train' WHEN r < t + v THEN 'validation' ELSE 'test' END"
    rest = f" UNION ALL SELECT g, 'train' FROM groups WHERE g < {holdout}" if holdout else ""
    return f"""groups AS (SELECT DISTINCT o_custkey AS g FROM orders), sizes AS (SELECT count(*) AS n, trunc(count(*) * 0.70::DOUBLE) AS t, trunc(count(*) * 0.15::DOUBLE) AS v FROM groups),
ranked AS (SELECT g, row_number() OVER (ORDER BY {_h('20260701', "'split'", 'g')}, g) - 1 AS r FROM groups {pool}),
splits AS (SELECT g AS "group", {cut} AS split FROM ranked, sizes{rest})"""


_SPLIT_ROWS = f'{_split(0)}, rows AS (SELECT o_orderkey, o_custkey, o_orderpriority, split FROM orders JOIN splits ON o_custkey = "group")'


def _overlap(key: str) -> str:
    def both(a: str, b: str) -> str:
        return f"count(*) FILTER (WHERE list_contains(s, '{a}') AND list_contains(s, '{b}'))"

    return f"""SELECT '{key}' AS key, {both('train', 'validation')} AS train_validation, {both('train', 'test')} AS train_test, {both('validation', 'test')} AS validation_test
FROM (SELECT {key}, list(DISTINCT split) AS s FROM rows GROUP BY 1)"""


_SPOKEN = f"""{_NAMES}, spoken AS (SELECT id, roster, CASE WHEN id % 3 = 0 THEN 'radio check over' ELSE 'calling ' || upper(roster[1]) || ', over' END AS text FROM names),
matched AS (SELECT *, list_filter(roster, lambda n: contains(' ' || {_norm('text')} || ' ', ' ' || {_norm('n')} || ' ')) AS pos FROM spoken),
drawn AS (SELECT *, list_slice({_shuffled(_without('roster', 'pos'), '20260701', 'id', "'vhf_clear'", "'neg'")}, 1, 4) AS neg,
  ('0x' || substr({_h('20260701', 'id', "'vhf_clear'", "'draw'")}, 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM matched),
keys AS (SELECT DISTINCT p_name AS nm, {_key('p_name')} AS k, {_letters(_key('p_name'))} AS l FROM part),
sounding AS (SELECT id, list(c.nm ORDER BY score DESC, c.k DESC, c.nm DESC) AS near FROM (
  SELECT d.id, c.n AS cand, coalesce(max(len(list_intersect(kc.l, kp.l))), 0) AS score FROM drawn d, unnest(d.roster) c(n) JOIN keys kc ON kc.nm = c.n LEFT JOIN (SELECT id, unnest(pos) AS p FROM drawn) q ON q.id = d.id LEFT JOIN keys kp ON kp.nm = q.p
  WHERE NOT list_contains(d.pos, c.n) GROUP BY d.id, c.n) s JOIN keys c ON c.nm = s.cand GROUP BY id),
typed AS (SELECT d.*, coalesce(near[:4], []) AS near, (u - 0.22) / (1.0 - 0.22) AS s FROM drawn d LEFT JOIN sounding USING (id)),
biased AS (SELECT *, CASE WHEN len(neg) > 0 AND u < 0.22 THEN 'vhf_error' WHEN len(pos) > 0 AND s < 0.45 THEN 'no_bias' WHEN len(pos) > 0 AND s < 0.65 THEN 'oracle_bias'
  WHEN len(pos) > 0 AND s < 0.90 THEN 'noisy_bias' WHEN len(pos) > 0 THEN 'distractor_bias' WHEN s < 0.50 THEN 'no_bias' ELSE 'distractor_bias' END AS bias FROM typed),
chosen AS (SELECT *, CASE bias WHEN 'oracle_bias' THEN pos WHEN 'noisy_bias' THEN {_shuffled('list_concat(pos, neg)', '20260701', 'id', "'vhf_clear'", "'cand'")} WHEN 'no_bias' THEN [] ELSE neg END AS cand,
  CASE WHEN bias <> 'vhf_error' THEN '' WHEN len(pos) > 0 THEN 'all_wrong_candidates_spoken_entity' ELSE 'all_wrong_candidates_no_spoken_entity' END AS error FROM biased)"""


def _bar(x: str) -> str:
    return f"coalesce(array_to_string({x}, '|'), '')"


def _view(mode: int, name: str, bias: str, pair: str, cand: str) -> str:
    said = _prompt(cand) if mode else "''"
    return f"SELECT id || '_vhf_clear_context{mode}' AS id, id || '_vhf_clear' AS paired_source_id, '{name}' AS view, {mode}::BIGINT AS context_mode, '{bias}' AS bias_type, '{pair}' AS counterfactual_pair_type, {said} AS prompt, {_bar(cand)} AS candidates, {_bar('near')} AS negatives FROM chosen"


_FLAT = "flat AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS uid, conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no, text FROM conversations)"
_PROFILES = ", ".join(f"('{p[0]}', {i}, {p[9]}, {p[10]})" for i, p in enumerate(PROFILES))
_SCENES = f"profiles AS (SELECT * FROM (VALUES {_PROFILES}) AS p(profile, i, crop, tail))"
_FRAMES = "frames AS (SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value, event_type FROM events)"
_STATS = f"{_FRAMES}, stats AS (SELECT series_id, count(*) AS frames, quantile_cont(value, 0.2) AS floor, median(value) AS median_level, greatest(quantile_cont(value, 0.2) + 12, median(value) + 6) AS threshold FROM frames GROUP BY 1)"
_RUNS = f"""{_STATS}, marked AS (SELECT f.series_id, i, floor, i - row_number() OVER (PARTITION BY f.series_id ORDER BY i) AS island FROM frames f JOIN stats USING (series_id) WHERE value > threshold),
runs AS (SELECT series_id, min(i) AS start_idx, max(i) + 1 AS end_idx, any_value(floor) AS floor FROM marked GROUP BY series_id, island HAVING count(*) >= 3)"""
_EVENTS = f"""{_RUNS}, hits AS (SELECT r.series_id, r.end_idx, min(f.i) AS event_idx FROM runs r JOIN frames f ON f.series_id = r.series_id AND f.i BETWEEN r.end_idx AND r.end_idx + 9
  WHERE f.value > r.floor + 18 AND abs(f.value) / 100 > 0.08 AND CASE WHEN event_type IN ('purchase', 'error') THEN 900 ELSE 600 END > 700 GROUP BY 1, 2)"""
_WAVE = "wave AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)"


def _rms(x: str) -> str:
    return f"20 * log10(sqrt(list_sum(list_transform({x}, lambda v: v * v)) / len({x}) + 1e-12) + 1e-12)"


def _peak(x: str) -> str:
    return f"list_max(list_transform({x}, lambda v: abs(v)))"


_POWER = f"""{_WAVE}, centred AS (SELECT vec_id, unnest(x) - list_sum(x) / 64 AS v, generate_subscripts(x, 1) - 1 AS j FROM wave),
shaped AS (SELECT vec_id, j, v * (0.5 - 0.5 * cos(2 * pi() * j / 63)) AS v FROM centred),
bins AS (SELECT vec_id, k, power(sum(v * cos(2 * pi() / 64 * ((k * j) % 64))), 2) + power(sum(v * sin(2 * pi() / 64 * ((k * j) % 64))), 2) AS p FROM shaped, range(0, 33) r(k) GROUP BY 1, 2),
summed AS (SELECT *, k * 375.0 AS hz, sum(p) OVER (PARTITION BY vec_id) + 1e-20 AS total, sum(p) OVER (PARTITION BY vec_id ORDER BY k) AS upto FROM bins)"""


def _band(lo: int, hi: int) -> str:
    return f"round(coalesce(sum(p) FILTER (WHERE hz >= {lo} AND hz < {hi}), 0) / max(total), 6)"


# a polyphase low-pass as the plain sum over the input samples that a tap reaches, up 80 and down 147
_RESAMPLE = """WITH bessel AS (SELECT i, (i - 1470) / 147.0 AS z,
  list_sum(list_transform(range(0, 26), lambda j: power(2.5 * sqrt(greatest(1 - power((i - 1470) / 1470.0, 2), 0)), 2 * j) / power(gamma(j + 1), 2))) AS w FROM range(0, 2941) r(i)),
raw AS (SELECT i, w * CASE WHEN i = 1470 THEN 1 ELSE sin(pi() * z) / (pi() * z) END AS h FROM bessel),
taps AS (SELECT i, h * 80 / (SELECT sum(h) FROM raw) AS h FROM raw),
y AS (SELECT vec_id, m, sum(h * embedding[(m * 147 + 1470 - i) // 80 % 64 + 1]::DOUBLE)::FLOAT::DOUBLE AS v FROM embeddings, (VALUES (10), (272), (540)) q(m), taps
  WHERE (m * 147 + 1470 - i) % 80 = 0 AND (m * 147 + 1470 - i) // 80 BETWEEN 0 AND 999 AND m * 147 + 1470 >= i GROUP BY 1, 2)
SELECT vec_id, ceil(1000 * 80 / 147.0)::BIGINT AS n_samples, list_sum([round(max(v) FILTER (m = 10), 4), 0.0]) AS sample_10, list_sum([round(max(v) FILTER (m = 272), 4), 0.0]) AS sample_272, list_sum([round(max(v) FILTER (m = 540), 4), 0.0]) AS sample_540 FROM y GROUP BY 1"""


def _cascade(low: float, high: float, rate: float = 24_000.0) -> list[float]:
    """Gain, then a1 and a2 of four sections with zeros at 1 and -1: the gain makes the centre of the band one."""
    w1, w2 = (math.tan(math.pi * f / rate) for f in (low, high))
    poles = []
    for k in range(4):
        b = cmath.exp(1j * math.pi * (2 * k + 5) / 8) * (w2 - w1) / 2
        r = cmath.sqrt(b * b - w1 * w2)
        poles += [(1 + s) / (1 - s) for s in (b + r, b - r)]
    sections = [(-2 * p.real, abs(p) ** 2) for p in poles if p.imag > 0]
    z = cmath.exp(2j * math.atan(math.sqrt(w1 * w2)))
    answer = math.prod(abs((z * z - 1) / (z * z + a1 * z + a2)) for a1, a2 in sections)
    return [1 / answer, *[a for s in sections for a in s]]


def _bandpass_sql() -> str:
    """The difference equations of the cascade, sample by sample, over the odd extension and back again."""
    rows = ", ".join(f"({p[0]!r}, {', '.join(f'{c!r}::DOUBLE' for c in _cascade(p[1], p[2]))})" for p in PROFILES)
    rest = ", ".join(f"0::DOUBLE AS s{k}{x}" for k in range(1, 5) for x in "ab")
    parts, before = [], "n0"
    for k in range(1, 5):
        back = "r.ub" if k == 1 else f"r.s{k - 1}b"
        parts.append(f"{before} - {back} - a{k} * r.s{k}a - b{k} * r.s{k}b AS n{k}")
        before = f"n{k}"

    def run(name: str, source: str, joined: str) -> str:
        step = f"SELECT r.vec_id, r.profile, r.i + 1 AS nxt, r.ua, r.s1a, r.s2a, r.s3a, r.s4a, g * e.v AS n0, {', '.join(parts)} FROM {name} r JOIN band USING (profile) JOIN {source} e ON e.i = r.i + 1 AND {joined}"
        moved = ", ".join(f"n{k}, s{k}a" for k in range(1, 5))
        profile = "band.profile" if source == "ext" else "e.profile"
        first = f"SELECT e.vec_id, {profile}, 0::BIGINT AS i, g * e.v AS ua, g * e.v AS ub, {rest} FROM {source} e JOIN band ON {'true' if source == 'ext' else 'band.profile = e.profile'} WHERE e.i = 0"
        return f"{name} AS ({first} UNION ALL SELECT vec_id, profile, nxt, n0, ua, {moved} FROM ({step}))"

    ext = """ext AS (SELECT vec_id, i, CASE WHEN i < 27 THEN 2 * x[1] - x[(27 - i) % 64 + 1] WHEN i < 267 THEN x[(i - 27) % 64 + 1] ELSE 2 * x[239 % 64 + 1] - x[(505 - i) % 64 + 1] END AS v FROM wave, range(0, 294) r(i))"""
    back = "again AS (SELECT vec_id, profile, 293 - i AS i, s4a AS v FROM there)"
    # adding zero to what rounds to -0.0 is what the query does
    pick = ", ".join(f"list_sum([round((max(s4a) FILTER (i = {266 - at}))::FLOAT::DOUBLE, 4), 0.0]) AS sample_{at}" for at in (60, 120))
    return f"WITH RECURSIVE {_WAVE}, band AS (SELECT * FROM (VALUES {rows}) AS p(profile, g, a1, b1, a2, b2, a3, b3, a4, b4)), {ext}, {run('there', 'ext', 'e.vec_id = r.vec_id')}, {back}, {run('home', 'again', 'e.vec_id = r.vec_id AND e.profile = r.profile')} SELECT vec_id, profile, 240::BIGINT AS n_samples, {pick} FROM home GROUP BY 1, 2"


#: Recordings: samples of a hundred vectors one after the other, as 16 bits would hold them.
_RECORDING = """heard AS (
  SELECT format('{:03d}.WAV', vec_id // 100) AS file, row_number() OVER (PARTITION BY vec_id // 100 ORDER BY vec_id, i) - 1 AS place,
    least(32767, greatest(-32768, round_even(x::DOUBLE * 32768, 0))) / 32768 AS v
  FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)),
lasting AS (SELECT file, count(*) AS n FROM heard GROUP BY file)"""


def all_sql() -> dict[str, str]:
    crop = "CASE WHEN trunc(crop / 1000.0::DOUBLE * 24000) BETWEEN 1 AND n - 1 THEN n - trunc(crop / 1000.0::DOUBLE * 24000) ELSE n END"
    length = f"({crop} + trunc(tail / 1000.0::DOUBLE * 24000))::BIGINT"
    sql = {
        "balanced_sample": f"WITH {_SAMPLE} SELECT doc_id, lang, row_number() OVER (ORDER BY k, doc_id::VARCHAR) AS sample_rank FROM sample",
        "balanced_sample_summary": f"WITH {_SAMPLE} SELECT lang, count(*) AS n_rows, count(DISTINCT source) AS n_sources FROM sample GROUP BY 1",
        "calibration_discovery": f"WITH {_DISCOVERY} SELECT id, profile FROM discovery",
        "calibration_confirmation": f"WITH {_CONFIRMATION} SELECT id, profile FROM confirmation",
        "train_remainder": f"WITH {_CONFIRMATION}, selected AS {_top('manifest', 100)} SELECT id, profile FROM selected WHERE id NOT IN (SELECT id FROM discovery) AND id NOT IN (SELECT id FROM confirmation)",
        "heldout_test": f"WITH {_TEST} SELECT id, profile, mode::BIGINT AS context_mode, '{CONTEXT_POLICY}' AS context_policy, {_PAIR} AS counterfactual_pair_type, id::VARCHAR AS no_prompt_source_id FROM (SELECT *, {_MODE} AS mode FROM test)",
        "counterfactual_fields": f"SELECT id, mode::BIGINT AS context_mode, {_PAIR} AS counterfactual_pair_type, '{CONTEXT_POLICY}' AS context_policy, 0::BIGINT AS n_bins FROM (SELECT id, {_MODE} AS mode FROM (SELECT o_orderkey AS id FROM orders))",
        "entity_family_raw": f"WITH {_NAMES} SELECT id, {_bar('list_sort(list_distinct(names))')} AS family FROM names",
        "entity_family_norm": f"WITH {_NAMES} SELECT id, {_bar('list_sort(list_distinct(list_transform(names, lambda n: upper(trim(n)))))')} AS family FROM names",
        "duplicate_ids": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
        "shard_of_path": "SELECT (o_orderkey % 9)::BIGINT AS shard, count(*) AS n FROM orders GROUP BY 1",
        "group_split": f"WITH {_split(0)} SELECT * FROM splits",
        "group_split_holdout": f"WITH {_split(50)} SELECT * FROM splits",
        "split_rows": f"WITH {_SPLIT_ROWS} SELECT o_orderkey, split FROM rows",
        "split_overlap": f"WITH {_SPLIT_ROWS} {_overlap('o_orderpriority')} UNION ALL {_overlap('o_custkey')}",
        "split_ratios": f"WITH {_SPLIT_ROWS} SELECT split, o_orderpriority, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY split)::DOUBLE, 6) AS ratio FROM rows GROUP BY 1, 2",
        "normalize_text": f"SELECT doc_id, {_norm('text')} AS normalized FROM documents",
        "phoneme_key": f"SELECT name, {_key('name')} AS phonemes FROM (SELECT p_name AS name FROM part UNION SELECT array_to_string(string_split(text, ' ')[:2], ' ') FROM benchmark)",
        "phoneme_similarity": f"WITH {_NAMES}, n AS (SELECT DISTINCT p_name AS nm, {_letters(_key('p_name'))} AS l FROM part), q AS (SELECT DISTINCT roster[1] AS a, unnest(roster[2:]) AS b FROM names) SELECT a, b, len(list_intersect(x.l, y.l))::BIGINT AS similarity FROM q JOIN n x ON x.nm = a JOIN n y ON y.nm = b",
        "entity_match": f"WITH d AS (SELECT doc_id, ' ' || {_norm('text')} || ' ' AS t FROM documents), r AS (SELECT DISTINCT array_to_string(string_split(text, ' ')[:2], ' ') AS name FROM benchmark) SELECT doc_id, name FROM d JOIN r ON contains(t, ' ' || {_norm('name')} || ' ')",
        "phoneme_map": f"WITH {_NAMES} SELECT id, {_bar(f'''list_transform(roster, lambda n: n || '=' || {_key('n')})''')} AS phonemes FROM names",
        "phoneme_negatives": f"""WITH {_NAMES}, keys AS (SELECT DISTINCT p_name AS nm, {_key('p_name')} AS k, {_letters(_key('p_name'))} AS l FROM part),
  c AS (SELECT id, roster, roster[1] AS pos, unnest(roster) AS cand FROM names),
  s AS (SELECT id, c.cand, x.k, len(list_intersect(x.l, y.l)) AS score, row_number() OVER (PARTITION BY id ORDER BY len(list_intersect(x.l, y.l)) DESC, x.k DESC, c.cand DESC) AS n FROM c JOIN keys x ON x.nm = cand JOIN keys y ON y.nm = pos WHERE {_norm('cand')} <> {_norm('pos')})
  SELECT names.id, coalesce(string_agg(cand, '|' ORDER BY n) FILTER (n <= 4), '') AS negatives FROM names LEFT JOIN s USING (id) GROUP BY 1""",
        "random_negatives": f"WITH {_NAMES} SELECT id, {_bar(f'''list_slice({_shuffled(_without('roster', '[roster[1]]'), '20260701', 'id', "'p'", "'neg'")}, 1, 4)''')} AS negatives FROM names",
        "bias_fields": f"""WITH {_SPOKEN} SELECT id || '_vhf_clear' AS id, bias AS bias_type, error AS context_error_type, CASE WHEN len(cand) > 0 THEN {_prompt('cand')} ELSE '' END AS prompt,
  'language English<asr_text>' || text AS text, text AS reference_text, {_bar('pos')} AS positive_entities, {_bar(_without('cand', 'pos'))} AS negative_entities, {_bar('cand')} AS candidate_entities, {_bar('near')} AS phoneme_negative_entities FROM chosen""",
        "unbiased_fields": f"WITH {_SPOKEN} SELECT id || '_vhf_clear' AS id, 'no_bias' AS bias_type, '' AS prompt, {_bar('pos')} AS positive_entities, '' AS negative_entities, '' AS candidate_entities, {_bar('near')} AS phoneme_negative_entities FROM chosen",
        "label_summary": f"WITH {_SPOKEN} SELECT bias AS bias_type, error AS context_error_type, count(*) AS n, count(*) FILTER (len(pos) > 0) AS entity_positive_rows, count(*) FILTER (len(cand) > 0) AS entity_candidate_rows, count(*) FILTER (len(near) > 0) AS phoneme_negative_rows FROM chosen GROUP BY 1, 2",
        "split_summary": f"""WITH {_SPOKEN}, {_split(0).replace('SELECT DISTINCT o_custkey AS g FROM orders', 'SELECT DISTINCT id % 100 AS g FROM names')},
  wide AS (SELECT c.*, id % 100 AS dialogue, unnest([split, 'all']) AS sp FROM chosen c JOIN splits ON "group" = id % 100),
  g AS (SELECT unnest([split, 'all']) AS sp FROM splits),
  b AS (SELECT sp, bias AS v, count(*) AS n FROM wide GROUP BY 1, 2), e AS (SELECT sp, error AS v, count(*) AS n FROM wide WHERE error <> '' GROUP BY 1, 2)
  SELECT sp AS split, (SELECT count(*) FROM g WHERE g.sp = w.sp) AS groups, count(DISTINCT dialogue) AS dialogues, count(DISTINCT id) AS utterances, count(*) AS records,
  count(*) FILTER (len(pos) > 0) AS entity_positive_rows, count(*) FILTER (len(cand) > 0) AS entity_candidate_rows, count(*) FILTER (len(near) > 0) AS phoneme_negative_rows, 'vhf_clear=' || count(*) AS profiles,
  (SELECT coalesce(string_agg(v || '=' || n, '|' ORDER BY v), '') FROM b WHERE b.sp = w.sp) AS bias_types, (SELECT coalesce(string_agg(v || '=' || n, '|' ORDER BY v), '') FROM e WHERE e.sp = w.sp) AS context_error_types
  FROM wide w GROUP BY sp""",
        "paired_views": f"WITH {_SPOKEN} " + " UNION ALL ".join((_view(0, "no_prompt", "no_bias", "no_context_control", "[]"), _view(1, "true_prompt", "noisy_bias", "supported_prompt_consistency", "list_concat(near, pos)"), _view(2, "unsupported_prompt", "vhf_error", "unsupported_prompt_invariance", "near"))),
        "asr_text": f"SELECT conv_id, turn, 'language English<asr_text>' || text AS target, {_prompt('[role, upper(role)]')} AS prompt FROM conversations",
        "roster_json": "SELECT p_partkey, to_json([p_name || ' x', p_name])::VARCHAR AS names FROM part",
        "parse_bool": "SELECT (quality = 1)::VARCHAR AS good, count(*) AS n FROM labels GROUP BY 1",
        "keyed_uniform": f"SELECT o_orderkey, ('0x' || substr({_h('20260701', 'o_orderkey', repr('draw'))}, 1, 13))::BIGINT AS draw FROM orders",
        "flatten_turns": f"""WITH {_FLAT} SELECT uid::VARCHAR AS utterance_id, conv_id::VARCHAR AS dialogue_id, turn_no::VARCHAR AS turn_id, '["Aurora Star","Arrow"]' AS ship_names, text FROM flat""",
        "shard_turns": f"WITH {_FLAT} SELECT (uid + 99)::VARCHAR AS utterance_id, conv_id::VARCHAR AS dialogue_id, turn_no::VARCHAR AS turn_id FROM flat WHERE (uid - 1) % 4 = 1 ORDER BY uid LIMIT 50",
        "turn_batches": f"WITH {_FLAT} SELECT ((uid - 1) // 8)::BIGINT AS batch, count(*) AS n, min(uid) AS first_uid FROM flat GROUP BY 1",
        "profile_cross": f"WITH {_FLAT}, {_SCENES} SELECT uid::VARCHAR AS utterance_id, profile, format('{{}}/{{:06d}}_{{}}.wav', profile, uid, profile) AS audio, NULL::VARCHAR AS noise_bank, uid - 1 AS record_index, (uid - 1) * 100 + i + 20260701 AS scene_seed FROM flat, profiles",
        "scene_lengths": f"WITH {_FLAT}, {_SCENES}, s AS (SELECT uid, length(text) AS n, profile, crop, tail FROM flat, profiles) SELECT uid::VARCHAR AS utterance_id, profile, {length} AS scene_samples FROM s",
        "pending_anti": "SELECT o_orderkey, format('{:06d}.wav', o_orderkey) AS clean_audio FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
        "clean_records": "SELECT o_orderkey, format('{:06d}.wav', o_orderkey) AS clean_audio, q AS clean_duration_sec, (CASE WHEN q IS NULL THEN 0 ELSE 24000 END)::BIGINT AS sample_rate FROM orders LEFT JOIN (SELECT l_orderkey, max(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey",
        "noise_class": """WITH e AS (SELECT event_id, ts, 20 * log10(value / 1000.0) AS lv, json_extract_string(props, '$.k')::DOUBLE / 100 AS band FROM events WHERE value > 0),
  c AS (SELECT *, CASE WHEN lv <= -58 THEN 'bed_static' WHEN lv <= -45 AND band >= 0.45 THEN 'weak_channel' WHEN lv > -45 AND lv <= -31 AND band >= 0.45 THEN 'busy_channel' END AS category FROM e)
  SELECT event_id, category, n AS category_index FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY ts, event_id) AS n FROM c WHERE category IS NOT NULL) WHERE n <= 128""",
        "frame_stats": f"WITH {_STATS} SELECT series_id, frames, round(floor, 6) AS floor, round(median_level, 6) AS median_level, round(threshold, 6) AS threshold FROM stats",
        "active_runs": f"WITH {_RUNS} SELECT series_id, start_idx, end_idx FROM runs",
        "tail_events": f"WITH {_EVENTS} SELECT * FROM hits",
        "event_clips": f"WITH {_EVENTS} SELECT h.series_id, end_idx, event_idx, count(*) AS n_frames, round(arg_max(value, i), 6) AS last_value FROM hits h JOIN frames f ON f.series_id = h.series_id AND f.i BETWEEN event_idx AND event_idx + 4 GROUP BY 1, 2, 3",
        "capped_events": f"WITH {_EVENTS} SELECT * FROM hits ORDER BY series_id, end_idx LIMIT 20",
        "jsonl_round_trip": "SELECT o_orderkey AS id, o_orderpriority AS profile, coalesce((SELECT string_agg(DISTINCT l_partkey::VARCHAR, '|' ORDER BY l_partkey::VARCHAR) FROM lineitem WHERE l_orderkey = o_orderkey), '') AS entities FROM orders",
        "utterance_csv": """SELECT (conv_id * 1000 + turn)::VARCHAR AS utterance_id, turn::VARCHAR AS turn_id, 'event "x", y' AS event, ' "a",' || chr(10) || text AS text FROM conversations""",
        "outputs_together": """WITH lines AS (SELECT o_orderkey % 2 AS half, o_orderkey, '{"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '"}' || chr(10) AS line FROM orders),
          texts AS (SELECT half, string_agg(line, '' ORDER BY o_orderkey) AS t FROM lines GROUP BY half)
          SELECT CASE half WHEN 0 THEN 'even.jsonl' ELSE 'odd.jsonl' END AS file, length(t)::BIGINT AS length, sha256(t) AS sha256 FROM texts""",
        "dialogue_lines": """WITH c AS (SELECT conv_id, count(*) AS turns, string_agg(text, '|' ORDER BY turn, role, text) AS t FROM conversations GROUP BY conv_id ORDER BY conv_id LIMIT 25)
          SELECT conv_id AS seq, conv_id::VARCHAR AS dialogue_id, turns, 'Aurora Star|Arrow' AS names, sha256(t) AS said FROM c""",
        "bank_document": "SELECT item_id::VARCHAR AS path, 'c' || item_id % 3 AS category, item_id / 8.0::DOUBLE AS start_sec, row_number() OVER (PARTITION BY item_id % 3 ORDER BY item_id) AS place FROM benchmark",
        "levels": f"WITH {_WAVE}, s AS (SELECT vec_id, list_transform(x, lambda v: v * (vec_id % 7 + 1)) AS x FROM wave) SELECT vec_id, round({_rms('x')}, 6) AS rms_db, round({_peak('x')}, 6) AS peak FROM s",
        "set_rms": f"WITH {_WAVE}, s AS (SELECT vec_id, list_transform(x, lambda v: v * power(10, (-36.0 - {_rms('x')}) / 20)) AS x FROM wave) SELECT vec_id, round(x[1], 6) AS first_sample, round({_peak('x')}, 6) AS peak FROM s",
        "saturate_clip": f"WITH {_WAVE}, s AS (SELECT vec_id, list_transform(x, lambda v: greatest(least(tanh(v * 8.0), 0.9), -0.9)) AS x FROM wave) SELECT vec_id, round(x[1], 6) AS first_sample, round({_peak('x')}, 6) AS peak FROM s",
        "crop_tile_window": f"WITH {_WAVE}, s AS (SELECT vec_id, x, (vec_id % 10 * 8)::BIGINT AS n FROM wave) SELECT vec_id, (CASE WHEN n BETWEEN 1 AND 63 THEN 64 - n ELSE 64 END)::BIGINT AS n_cropped, round(x[CASE WHEN n BETWEEN 1 AND 63 THEN n + 1 ELSE 1 END], 6) AS first_cropped, 150::BIGINT AS n_tiled, round(x[150 - 128], 6) AS last_tiled, 4::BIGINT AS n_window FROM s",
        "mono_mix": f"WITH {_WAVE} SELECT vec_id, round((x[1] + x[64]) / 2, 6) AS first_sample, 64::BIGINT AS n FROM wave",
        "wave_frames": f"WITH {_WAVE}, f AS (SELECT vec_id, i, x[i * 10 + 1 : least(i * 10 + 10, 64)] AS x FROM wave, range(0, 7) r(i)) SELECT vec_id, i::BIGINT AS frame_idx, len(x)::BIGINT AS n, round({_rms('x')}, 6) AS rms_db FROM f",
        "wav_frames": f"WITH {_RECORDING} SELECT file, 24000 AS sample_rate, place // 250 AS frame_idx, count(*) AS n, round(arg_min(v, place), 6) AS first_sample, round(arg_max(v, place), 6) AS last_sample FROM heard GROUP BY file, place // 250",
        "wav_frames_of_two": f"WITH {_RECORDING} SELECT file, ceil(n / 1000)::BIGINT AS frames, n AS samples FROM lasting WHERE n >= 1200 ORDER BY file LIMIT 2",
        "wav_decode": f"WITH {_RECORDING} SELECT file, 24000 AS sample_rate, count(*) AS n, sha256(string_agg((v * 32768)::BIGINT::VARCHAR, ',' ORDER BY place)) AS sha256 FROM heard GROUP BY file",
        "wav_probe": f"WITH {_RECORDING} SELECT file, 24000 AS sample_rate, 1::BIGINT AS channels, n AS n_frames, round(n / 24000, 9) AS duration_sec FROM lasting",
        "wav_windows": f"""WITH {_RECORDING}, s AS (SELECT file, n, (n / 24000 - 0.01) * k / 2 AS start FROM (SELECT * FROM lasting ORDER BY file LIMIT 5), range(3) r(k)),
          p AS (SELECT *, trunc(start::DOUBLE * 24000)::BIGINT AS first FROM s)
          SELECT p.file, round(start::DOUBLE, 6) AS start_sec, least(240, n - first) AS n, round(v, 6) AS first_sample FROM p JOIN heard h ON h.file = p.file AND h.place = p.first""",
        "spectral_features": f"WITH {_POWER}, loud AS (SELECT vec_id, 20 * log10(sqrt(sum(v * v) / 64 + 1e-12) + 1e-12) AS lv FROM centred GROUP BY 1) SELECT vec_id, (SELECT round(lv, 6) FROM loud WHERE loud.vec_id = summed.vec_id) AS rms_db, {_band(0, 300)} AS energy_0_300, {_band(300, 3400)} AS energy_300_3400, {_band(3400, 8000)} AS energy_3400_8000, {_band(8000, 12000)} AS energy_8000_plus, round(sum(hz * p) / max(total), 3) AS centroid_hz, least(count(*) FILTER (WHERE upto < 0.95 * total), 32) * 375.0::DOUBLE AS rolloff95_hz FROM summed GROUP BY 1",
        "noise_lookup": f"WITH r AS (SELECT vec_id, 'c' || label AS category, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings), q AS (SELECT *, ('0x' || substr({_h('20260701', repr('bank'), 'vec_id')}, 1, 13))::BIGINT % n AS pick FROM r) SELECT q.vec_id, q.category, r.vec_id::VARCHAR AS item_path FROM q JOIN r ON r.category = q.category AND r.i = q.pick",
        "augment": f"WITH {_SCENES}, s AS (SELECT vec_id, 2400 AS n, profile, crop, tail FROM embeddings, profiles) SELECT vec_id, profile, {length} AS n_samples, true AS within FROM s",
        "add_tail": f"WITH {_SCENES} SELECT vec_id, profile, (2400 + trunc(tail / 1000.0::DOUBLE * 24000))::BIGINT AS n_samples, round(embedding[1]::DOUBLE, 6) AS sample_0, round(embedding[2399 % 64 + 1]::DOUBLE, 6) AS sample_2399 FROM embeddings, profiles",
        "add_noises": f"SELECT vec_id, profile, 2400::BIGINT AS n_samples, snr FROM embeddings, (VALUES {', '.join(f'({p[0]!r}, {p[3]}::DOUBLE)' for p in PROFILES)}) AS p(profile, snr)",
        "resample": _RESAMPLE,
        "bandpass": _bandpass_sql(),
        "content_digest": """WITH r AS (SELECT sha256(to_json({'doc_id': doc_id, 'lang': lang, 'source': source})::VARCHAR) AS h FROM documents), l AS (SELECT left(h, 3) AS lane, count(*) AS n, sha256(string_agg(h, ',' ORDER BY h)) AS d FROM r GROUP BY 1)
  SELECT sum(n)::BIGINT AS n_rows, sha256(string_agg(d, ',' ORDER BY lane)) AS digest FROM l""",
        "priority_counter": "SELECT string_agg(p || '=' || n, '|' ORDER BY p) AS counts FROM (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1)",
        "selection_summary": "SELECT (SELECT count(*) FROM orders) AS records, (SELECT count(DISTINCT o_custkey) FROM orders) AS dialogues, (SELECT count(DISTINCT o_orderkey) FROM orders) AS utterances, (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)) AS entities",
    }
    sql["views_round_trip"] = f"SELECT view, count(*) AS n, count(DISTINCT id) AS ids, count(prompt) AS prompts FROM ({sql['paired_views']}) GROUP BY view"
    sql["splits_round_trip"] = f"SELECT r.o_orderkey, o.o_custkey, r.split FROM ({sql['split_rows']}) r JOIN orders o USING (o_orderkey)"
    return sql
