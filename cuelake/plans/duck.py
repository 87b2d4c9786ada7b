"""DuckDB text of the column functions, for the oracles only."""

from cuelake.functions import text as T

_WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def strip(x):
    return f"regexp_replace(regexp_replace({x}, '^{_WS}+', ''), '{_WS}+\\z', '')"


def count_in(x, chars):
    return f"(length({x}) - length(regexp_replace({x}, '{chars}', '', 'g')))"


def is_unspaced(x):
    seen = f"length(regexp_replace({x}, '{_WS}', '', 'g'))"
    return f"({seen} > 0 AND {count_in(x, T.UNSPACED)} >= {seen} * 0.5)"


def units(x):
    s = strip(x)
    return f"(CASE WHEN length({s}) = 0 THEN 0 WHEN {is_unspaced(s)} THEN length({s}) ELSE len(string_split_regex({s}, '{_WS}+')) END)"


def ends_sentence(x):
    return f"regexp_matches({strip(x)}, '[{T.ENDERS}]\\z')"


def is_fragment(x):
    s = strip(x)
    return f"(NOT {ends_sentence(x)} AND NOT (NOT {is_unspaced(s)} AND length({s}) > 20) AND {units(x)} > 0 AND {units(x)} <= (CASE WHEN {is_unspaced(s)} THEN 2 ELSE 2 END))"


def is_single_sentence(x):
    q = T.CLOSERS.replace("'", "''")
    inner = strip(f"regexp_replace({strip(x)}, '[{T.ENDERS}{q}]+\\z', '')")
    return f"(length({inner}) > 0 AND NOT regexp_matches({inner}, '[{T.ENDERS}]'))"


def tokens(x):
    return f"({count_in(x, T.DENSE)} + (length({x}) - {count_in(x, T.DENSE)}) // 4 + 1)"


def join_text(a, b):
    return f"(CASE WHEN {a} = '' OR {b} = '' OR regexp_matches({a}, '{T.TIGHT}\\z') OR regexp_matches({b}, '^{T.TIGHT}') THEN {a} || {b} ELSE {a} || ' ' || {b} END)"


def clock(x, unit, form):
    n = f"round_even(greatest({x}, 0.0) * {unit}, 0)::BIGINT"
    return f"printf('{form}', {n} // {3600 * unit}, {n} // {60 * unit} % 60, {n} // {unit} % 60, {n} % {unit})"


def words(x):
    p = T.PUNCTUATION.replace("'", "''")
    return f"list_filter(regexp_extract_all(lower({x}), '[0-9a-z'']+|[^0-9a-z''\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]'), lambda w: length(w) > 1 OR NOT contains('{p}', w))"


def half_even(x):
    """x to 3 decimals, ties of its shortest decimal form to even, as Spark rounds a double."""
    up = "d - floor(d) > 0.5 OR (d - floor(d) = 0.5 AND floor(d) % 2 = 1)"
    return f"(list_transform([({x})::VARCHAR::DECIMAL(27, 18) * 1000], lambda d: floor(d) + CASE WHEN {up} THEN 1 ELSE 0 END)[1]::DOUBLE / 1000)"


def wrap(source, x):
    """A query of (video_id, index, wrapped) over the column x of source; limit 42."""
    return f"""SELECT video_id, index, CASE WHEN n <= 42 OR k IS NULL THEN x ELSE {strip('substr(x, 1, k)')} || chr(10) || {strip('substr(x, k + 1)')} END AS wrapped FROM (
  SELECT *, list_sort(list_transform(cuts, lambda k: {{'wide': greatest(length({strip('substr(x, 1, k)')}), length({strip('substr(x, k + 1)')})) > 42, 'off': abs(k - n / 2), 'k': k}}))[1].k AS k FROM (
    SELECT video_id, index, x, length(x) AS n, list_transform(list_filter(range(1, length(x) - 1), lambda i: contains('{T.BREAKS}', substr(x, i + 1, 1))),
      lambda i: CASE WHEN substr(x, i + 1, 1) = ' ' THEN i ELSE i + 1 END) AS cuts FROM (SELECT video_id, index, {strip(x)} AS x FROM {source})))"""


def bag_kept(a, b):
    """Size of the bag intersection of two lists of words."""
    return f"coalesce(list_sum(list_transform(list_distinct({a}), lambda w: least(len(list_filter({a}, lambda x: x = w)), len(list_filter({b}, lambda x: x = w)))))::BIGINT, 0)"


def _stray(x):
    return f"list_transform([{x}], lambda h: {units('h')} > 0 AND {units('h')} <= CASE WHEN {is_unspaced(strip('h'))} THEN 3 ELSE 1 END)[1]"


def word_cues(source, budget=84, longest=6.0):
    """CTEs up to word_cues (video_id, seg_no, cue_no, start, "end", text) from source (video_id, seg_no, word_no,
    start, "end", text): one step of the recursion takes one word of every segment. t, s, e: texts, starts and
    ends of a segment; i: first word of the open cue; j: the word at hand; cuts: where cues end."""
    head = lambda i, j: strip(f"array_to_string(t[({i}) + 1:({j})], '')")
    begins = lambda i, j: f"coalesce(s[list_filter(range({i} + 1, {j}), lambda k: s[k + 1] - e[k] > 1.5 AND len(list_filter(range({i} + 1, k + 1), lambda m: NOT {_stray(head(i, 'm'))})) = 0)[1] + 1], s[{i} + 1])"
    mark = lambda chars: f"list_max(list_filter(range(i + 1, j), lambda k: length({head('i', 'k')}) >= 0.4 * length(h) AND length(h) > 0 AND regexp_matches({head('i', 'k')}, '[{chars}]\\z')))"
    return f"""seg AS (SELECT video_id, seg_no, list(text ORDER BY word_no) AS t, list(start ORDER BY word_no) AS s, list("end" ORDER BY word_no) AS e FROM {source} GROUP BY ALL),
step AS (SELECT video_id, seg_no, 0 AS j, 0 AS i, []::INT[] AS cuts FROM seg
  UNION ALL SELECT video_id, seg_no, j + 1, CASE WHEN closes THEN j + 1 ELSE coalesce(c, i) END,
    cuts || CASE WHEN c IS NULL THEN []::INT[] ELSE [c] END || CASE WHEN closes THEN [j + 1] ELSE []::INT[] END
  FROM (SELECT *, (CASE WHEN j > i THEN CASE WHEN (s[j + 1] - e[j] > 1.5 OR e[j + 1] - {begins('i', 'j')} > {longest}) AND NOT {_stray('h')} THEN j
      WHEN length(h) + length(regexp_replace(t[j + 1], '{_WS}+\\z', '')) > {budget} THEN coalesce({mark(T.ENDERS)}, {mark(T.CLAUSES)}, j) END END)::INT AS c
    FROM (SELECT step.*, t, s, e, {head('i', 'j')} AS h, {ends_sentence('t[j + 1]')} AS closes FROM step JOIN seg USING (video_id, seg_no) WHERE j < len(t)))),
spans AS (SELECT video_id, seg_no, t, s, e, unnest([0] || a) AS i, unnest(a || [NULL]) AS j FROM (
  SELECT seg.*, CASE WHEN i < len(t) THEN cuts || [len(t)::INT] ELSE cuts END AS a FROM step JOIN seg USING (video_id, seg_no) WHERE j = len(t))),
word_cues AS (SELECT video_id, seg_no, row_number() OVER (PARTITION BY video_id, seg_no ORDER BY i)::INT AS cue_no,
  {half_even(f"greatest({begins('i', 'j')}, greatest(e[j], s[i + 1] + 0.5) - {longest})")} AS start, {half_even('greatest(e[j], s[i + 1] + 0.5)')} AS "end", {head('i', 'j')} AS text
  FROM spans WHERE j IS NOT NULL AND {head('i', 'j')} <> '')"""


def _packed(parts, limit):
    both = f"CASE WHEN a[-1] = '' THEN p[1] ELSE {strip("a[-1] || ' ' || p[1]")} END"
    return f"list_filter(list_reduce(list_transform({parts}, lambda x: [x]), lambda a, p: CASE WHEN a[-1] = '' OR length({both}) <= {limit} THEN a[:-2] || [{both}] ELSE a || p END), lambda x: x <> '')"


def split(x, limit):
    """Pieces of at most limit characters of a stripped text."""
    after = lambda p, ends: f"list_filter(list_transform(string_split_regex(regexp_replace({p}, '([{ends}]){_WS}*', '\\1' || chr(1), 'g'), chr(1)), lambda z: {strip('z')}), lambda z: z <> '')"
    level = lambda pieces, parts: f"flatten(list_transform({pieces}, lambda p0: CASE WHEN length(p0) <= {limit} OR len({parts('p0')}) < 2 THEN [p0] ELSE {_packed(parts('p0'), limit)} END))"
    a = level(f"list_filter([{x}], lambda z: z <> '')", lambda p: after(p, T.ENDERS))
    b = level(a, lambda p: after(p, T.CLAUSES))
    c = level(b, lambda p: f"string_split({p}, ' ')")
    return f"flatten(list_transform({c}, lambda p1: CASE WHEN length(p1) <= {limit} THEN [p1] ELSE list_transform(range(0, ceil(length(p1) / {limit})::BIGINT), lambda k: substr(p1, k * {limit} + 1, {limit})) END))"


def text_cues(source, longest=6.0):
    """CTEs up to text_cues (video_id, seg_no, cue_no, start, "end", text) from source (video_id, seg_no, start,
    "end", text)."""
    reading = "greatest(length(text) / 3.0, 0.5)"
    return f"""capped AS (SELECT *, greatest("end" - start, 0.5) AS duration FROM (SELECT video_id, seg_no, start, CASE WHEN "end" - start > 2 * {reading} THEN start + {reading} ELSE "end" END AS "end", {strip('text')} AS text FROM {source})),
finer AS (SELECT video_id, seg_no, 0 AS step, pieces, ceil(duration / {longest}) AS need, duration / len(pieces) <= {longest} AS done FROM (SELECT *, {split('text', 42)} AS pieces FROM capped) WHERE len(pieces) > 0
  UNION ALL SELECT video_id, seg_no, step + 1, CASE WHEN len(halves) > 1 THEN pieces[:k - 1] || halves || pieces[k + 1:] ELSE pieces END, need, len(halves) < 2
  FROM (SELECT *, CASE WHEN n >= 12 THEN {split('pieces[k]', '(n // 2)')} ELSE []::VARCHAR[] END AS halves
    FROM (SELECT *, list_position(list_transform(pieces, lambda x: length(x)), n) AS k FROM (SELECT *, list_max(list_transform(pieces, lambda x: length(x))) AS n FROM finer WHERE NOT done AND len(pieces) < need)))),
final AS (SELECT video_id, seg_no, arg_max(pieces, step) AS pieces FROM finer GROUP BY ALL),
parts AS (SELECT video_id, seg_no, unnest(pieces) AS text, unnest(range(1, len(pieces) + 1)) AS cue_no, list_sum(list_transform(pieces, lambda x: length(x))) AS total FROM final),
placed AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY video_id, seg_no ORDER BY cue_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM parts),
text_cues AS (SELECT video_id, seg_no, cue_no::INT AS cue_no, {half_even('start + duration * before::DOUBLE / total')} AS start, {half_even('least(start + duration * (before + length(p.text))::DOUBLE / total, "end")')} AS "end", p.text
  FROM placed p JOIN capped USING (video_id, seg_no))"""


def merged(source):
    """CTEs up to merged (video_id, index, start, "end", text) from source (video_id, i, start, "end", text), i from 1."""
    return f"""pu AS (SELECT video_id, avg(CASE WHEN {ends_sentence('text')} THEN 0.0 ELSE 1.0 END) <= 0.5 AS p FROM {source} GROUP BY video_id),
x AS (SELECT {source}.*, p, {is_fragment('text')} AS frag, {ends_sentence('text')} AS ends FROM {source} JOIN pu USING (video_id)),
f AS (SELECT video_id, i, 1 AS cue, start, "end", text, frag, ends FROM x WHERE i = 1
  UNION ALL SELECT b.video_id, b.i, CASE WHEN m THEN cue ELSE cue + 1 END, CASE WHEN m THEN s0 ELSE b.start END, b."end", CASE WHEN m THEN joined ELSE b.text END, CASE WHEN m THEN {is_fragment('joined')} ELSE b.frag END, CASE WHEN m THEN {ends_sentence('joined')} ELSE b.ends END FROM (
    SELECT n.*, f.cue, f.start AS s0, {join_text('f.text', 'n.text')} AS joined, CASE WHEN f.frag OR n.frag THEN NOT (n.frag AND f.ends) AND n.start - f."end" <= 1.5 ELSE n.p AND NOT f.ends AND n.start - f."end" <= 0.8 END
      AND length({join_text('f.text', 'n.text')}) <= 84 AND n."end" - f.start <= 7.0 AS m FROM f JOIN x n ON n.video_id = f.video_id AND n.i = f.i + 1) b),
merged AS (SELECT video_id, cue AS index, arg_min(start, i) AS start, arg_max("end", i) AS "end", arg_max(text, i) AS text FROM f GROUP BY video_id, cue)"""
