"""Quotation linking: conversations without quotes, in reply order.

A line that starts with quote marks is quoted at as many levels as it has marks; lines such as
"Ann wrote:" that lead to a quote go with it. Quoted and own lines are normalised (marks off, white space
collapsed, lower case) and hashed, and so are passages: the paragraphs and runs of lines of one level with
line breaks collapsed, so that a passage wrapped anew is still known. A quoted line may come from every
earlier turn of its conversation that has the line, or the passage it stands in, as its own. A message
replies to the turn that most of its least deeply quoted lines come from. Threads follow from the replies
by pointer doubling, and so does the place of each message in its thread. Only built-in functions and joins
are used. Turns that have the same of the quoted hashes as their own are one group: only its latest turn
before a quote can be the answer, so a line that everybody says and everybody quotes does not give all
pairs of turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from cuelake.llm.common import SPACE, let
from cuelake.session import cut, read_table

#: Quote marks at the start of a line: ">" with spaces before and between.
MARKS = r"^[\x20\t]*(?:>[\x20\t]?)+"
#: What introduces a quote, as a whole line.
INTRODUCTION = r"(?i)^.*\b(wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$"


def normalise(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, MARKS, ""), rf"[{SPACE}]+", " ")))


def parse(turns: DataFrame) -> DataFrame:
    """turns with _lines, an array of (level, line, key): key hashes the normalised line, null if it is blank."""

    def line(x: Column) -> Column:
        level = F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", ""))
        plain = normalise(x)
        return F.struct(level.alias("level"), x.alias("line"), F.when(plain != "", F.xxhash64(plain)).alias("key"))

    return turns.withColumn("_lines", F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line))


def passages(lines: Column) -> Column:
    """Array of (level, line, keys) of the lines that are not blank, from _lines: keys hash the line,
    its paragraph and its run of lines of one level. Introductions have level -1."""
    intro = lambda x, i: (x["level"] == 0) & (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > 0) & x["line"].rlike(INTRODUCTION)
    kinds = F.transform(lines, lambda x, i: F.struct(F.when(intro(x, i), F.lit(-1)).otherwise(x["level"]).alias("level"), F.translate(normalise(x["line"]), "\x02\x03\x04", "").alias("plain")))

    def marked(all_: Column) -> Column:  # runs begin with \x02, level and \x04, paragraphs with \x03, lines with a line break
        def one(x: Column, i: Column) -> Column:
            opens = (i == 0) | (F.get(all_, i - 1)["level"] != x["level"])
            return F.concat(F.when(opens, F.concat(F.lit("\x02"), x["level"].cast("string"), F.lit("\x04"))).otherwise(""), F.when(x["plain"] == "", "\x03").otherwise(F.concat(F.lit("\n"), x["plain"])))

        return F.array_join(F.transform(all_, one), "")

    collapsed = lambda t: F.trim(F.regexp_replace(t, "[\x03\n]+", " "))

    def of_run(run: Column) -> Column:
        parts = F.split(run, "\x04")
        level, whole = parts[0].cast("int"), F.xxhash64(collapsed(parts[1]))

        def of_line(x: Column, paragraph: Column, whole: Column) -> Column:
            return let(F.xxhash64(x), lambda own: F.struct(level.alias("level"), own.alias("line"), F.array_distinct(F.array(own, paragraph, whole)).alias("keys")))

        def of_paragraph(p: Column, whole: Column) -> Column:
            return let(F.xxhash64(collapsed(p)), lambda h: F.transform(F.array_remove(F.split(p, "\n"), ""), lambda x: of_line(x, h, whole)))

        return let(whole, lambda w: F.flatten(F.transform(F.split(parts[1], "\x03"), lambda p: of_paragraph(p, w))))

    return F.flatten(F.transform(F.array_remove(F.split(let(kinds, marked), "\x02"), ""), of_run))


def body(lines: Column) -> Column:
    """The own lines of a message: not quoted, not introducing a quote, without blank edges."""
    own = F.filter(lines, lambda x, i: (x["level"] == 0) & ~((F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > 0) & x["line"].rlike(INTRODUCTION)))
    return F.regexp_replace(F.array_join(F.transform(own, lambda x: x["line"]), "\n"), rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def threads(links: DataFrame) -> DataFrame:
    """conv_id, turn, root_turn, depth of all turns that reply, from links (conv_id, turn, reply_to).

    Each round doubles how far a turn sees; it stops when all see a turn that replies to nothing.
    """
    up = cut(links.select("conv_id", "turn", F.col("reply_to").alias("at"), F.lit(1).alias("depth")))
    while True:
        parents = up.select(F.col("conv_id").alias("_c"), F.col("turn").alias("at"), F.col("at").alias("_up"), F.col("depth").alias("_d"))
        joined = up.join(parents, (up.conv_id.eqNullSafe(parents._c)) & (up.at == parents["at"]), "left").select("conv_id", "turn", F.coalesce("_up", up.at).alias("at"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"), F.col("_up").isNotNull().alias("moved"))
        up = cut(joined)
        if not up.where("moved").limit(1).count():
            return up.select("conv_id", "turn", F.col("at").alias("root_turn"), "depth")


def positions(tree: DataFrame) -> DataFrame:
    """conv_id, turn, n of the messages of threads, from tree (conv_id, turn, reply_to), which has every message
    that replies or is replied to: n counts the messages from this one on, in reply order: every reply after what it
    answers, and all that follows from it before the next reply to the same message.

    A walk around the thread enters and leaves each message once. Its steps are a linked list, and how many messages
    are entered from a step to the end is found by pointer doubling: the rounds grow with the logarithm of the
    longest thread, and no thread is gathered anywhere.
    """
    siblings = Window.partitionBy("conv_id", "reply_to").orderBy("turn")
    own = tree.withColumn("_next", F.when(F.col("reply_to").isNotNull(), F.lead("turn").over(siblings)))
    first = tree.where("reply_to is not null").groupBy(F.col("conv_id").alias("_c"), F.col("reply_to").alias("_t")).agg(F.min("turn").alias("_first"))
    own = own.join(first, own.conv_id.eqNullSafe(F.col("_c")) & (own.turn == F.col("_t")), "left").drop("_c", "_t")
    step = lambda turn, leave: F.when(turn.isNotNull(), F.struct(turn.alias("turn"), F.lit(leave).alias("leave")))
    enter = own.select("conv_id", step(F.col("turn"), False).alias("at"), F.coalesce(step(F.col("_first"), False), step(F.col("turn"), True)).alias("ahead"), F.lit(1).alias("n"))
    leave = own.select("conv_id", step(F.col("turn"), True).alias("at"), F.coalesce(step(F.col("_next"), False), step(F.col("reply_to"), True)).alias("ahead"), F.lit(0).alias("n"))
    walk = cut(enter.unionByName(leave))
    while walk.where("ahead is not null").limit(1).count():
        ahead = walk.select(F.col("conv_id").alias("_c"), F.col("at").alias("_at"), F.col("ahead").alias("_to"), F.col("n").alias("_n"))
        walk = cut(walk.join(ahead, walk.conv_id.eqNullSafe(ahead._c) & (walk.ahead == ahead._at), "left").select("conv_id", "at", F.col("_to").alias("ahead"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n")))
    left = walk.where(~F.col("at.leave")).select("conv_id", F.col("at.turn").alias("turn"), "n")
    return left


def link_quotes(turns: DataFrame) -> DataFrame:
    """One row per row of turns (conv_id, turn, role, text): conv_id, turn, role, body, n_quoted, max_level,
    n_linked, reply_to, root_turn, depth, position. In the order (conv_id, root_turn, position) a conversation is in
    reply order: each thread by its first turn, every reply after what it answers, branches one after another.

    A message that quotes nothing known starts a thread (reply_to null, depth and position 0, root_turn its own turn).
    Ties between turns that a message quotes equally go to the later turn. A null text is empty; a null
    conv_id is a conversation of its own, rows with a null turn or a repeated (conv_id, turn) are kept but
    the repeats count as one message for linking. Texts are read whole, however long. Other columns are ignored.
    No rows give no rows.
    """
    own = parse(turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"))
    facts = own.select(
        "conv_id", "turn", "role", body(F.col("_lines")).alias("body"),
        F.size(F.filter("_lines", lambda x: x["level"] > 0)).cast("long").alias("n_quoted"),
        F.array_max(F.transform("_lines", lambda x: x["level"])).cast("long").alias("max_level"),
    )
    quoting = own.where(F.exists("_lines", lambda x: x["level"] > 0))
    quoted = quoting.where("turn is not null").select("conv_id", "turn", F.explode(F.filter(passages(F.col("_lines")), lambda x: x["level"] > 0)).alias("x"))
    quoted = cut(quoted.select("conv_id", "turn", "x.line", "x.level", F.explode("x.keys").alias("key")).groupBy("conv_id", "turn", "line", "key").agg(F.min("level").alias("level")))
    # What of the quoted each turn has as its own, and the groups of turns that have the same.
    wanted = quoted.select("conv_id", "key").distinct()
    plain = F.transform(F.filter("_lines", lambda x: (x["level"] == 0) & x["key"].isNotNull()), lambda x: x["key"])
    of_own = F.flatten(F.transform(F.filter(passages(F.col("_lines")), lambda x: x["level"] == 0), lambda x: x["keys"]))
    asked = quoted.select(F.col("conv_id").alias("_q")).distinct()
    near = own.where("turn is not null").join(asked, own.conv_id.eqNullSafe(F.col("_q")), "left_semi")
    said = near.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.explode(F.array_distinct(F.concat(plain, of_own))).alias("_k"))
    said = said.join(wanted, wanted.conv_id.eqNullSafe(said._c) & (wanted.key == said._k)).groupBy("_c", "_t").agg(F.array_sort(F.collect_set("_k")).alias("keys"))
    said = cut(said.withColumn("group", F.xxhash64("keys")))
    groups = said.groupBy("_c", "group", "keys").agg(F.min("_t").alias("first")).select("_c", "group", "first", F.explode("keys").alias("_k"))
    linked = cut(quoted.join(groups, quoted.conv_id.eqNullSafe(groups._c) & (quoted.key == groups._k) & (groups["first"] < quoted.turn)).groupBy("conv_id", "turn", "group", "line").agg(F.min("level").alias("level")))
    n_linked = linked.groupBy("conv_id", "turn").agg(F.count_distinct("line").alias("n_linked"))
    by = linked.groupBy("conv_id", "turn", "group").agg(F.count(F.lit(1)).alias("n"), F.min("level").alias("level"))
    # The latest turn of each group before the quote: quotes come before what is said in the same turn.
    events = by.withColumn("said", F.lit(None).cast("long")).unionByName(said.select(F.col("_c").alias("conv_id"), F.col("_t").alias("turn"), "group", F.col("_t").alias("said")), allowMissingColumns=True)
    before = Window.partitionBy("conv_id", "group").orderBy("turn", F.col("said").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    by = events.withColumn("source", F.last("said", ignorenulls=True).over(before)).where("n is not null")
    best = by.groupBy("conv_id", "turn").agg(F.max_by("source", F.struct(-F.col("level"), "n", "source")).alias("reply_to"))
    total = n_linked.select(F.col("conv_id").alias("_nc"), F.col("turn").alias("_nt"), "n_linked")
    best = cut(best.join(total, best.conv_id.eqNullSafe(total._nc) & (best.turn == total._nt)).select("conv_id", "turn", "n_linked", "reply_to"))
    roots = threads(best)
    # The messages that only are replied to join in as the first of their threads.
    above = roots.groupBy("conv_id", F.col("root_turn").alias("turn")).agg(F.lit(None).cast("long").alias("reply_to"))
    tree = cut(best.select("conv_id", "turn", "reply_to").unionByName(above))
    ranks = positions(tree)
    whole = ranks.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("n").alias("_all"))
    placed = best.select("conv_id", "turn", "n_linked", "reply_to")
    named = roots.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), "root_turn", "depth")
    placed = placed.join(named, placed.conv_id.eqNullSafe(F.col("_c")) & (placed.turn == F.col("_t"))).drop("_c", "_t")
    placed = placed.join(whole, placed.conv_id.eqNullSafe(F.col("_c")) & (placed.root_turn == F.col("_t"))).drop("_c", "_t")
    ranks = ranks.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), "n")
    found = placed.join(ranks, placed.conv_id.eqNullSafe(F.col("_c")) & (placed.turn == F.col("_t")))
    found = found.select(F.col("_c").alias("_conv"), F.col("_t").alias("_turn"), "n_linked", "reply_to", "root_turn", "depth", (F.col("_all") - F.col("n")).cast("long").alias("position"))
    out = facts.join(found, facts.conv_id.eqNullSafe(found._conv) & (facts.turn == found._turn), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("conv_id", "turn", "role", "body", "n_quoted", "max_level", zero("n_linked"), "reply_to", F.coalesce("root_turn", "turn").alias("root_turn"), zero("depth"), zero("position"))


def op5_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(read_table(spark, sf_dir, "conversations"))


_SPACE_SQL = r"[ \t-\r]"
_MARKS_SQL = r"^[ \t]*(?:>[ \t]?)+"
_INTRO_SQL = r"(?i)^.*\b(wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$"
#: Lines with level (-1: introduction) and plain text; runs of one level and their paragraphs; the keys of each line.
OP5_SQL = rf"""
WITH RECURSIVE l0 AS (SELECT conv_id, turn, role, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS line FROM (SELECT *, string_split(coalesce(text, ''), chr(10)) AS parts FROM conversations)),
l AS (SELECT *, length(regexp_replace(regexp_extract(line, '{_MARKS_SQL}'), '[^>]', '', 'g')) AS level, lower(trim(regexp_replace(regexp_replace(line, '{_MARKS_SQL}', ''), '{_SPACE_SQL}+', ' ', 'g'), ' ')) AS plain FROM l0),
m AS (SELECT *, level = 0 AND coalesce(lead(level) OVER (PARTITION BY conv_id, turn ORDER BY i), 0) > 0 AND regexp_matches(line, '{_INTRO_SQL}') AS intro FROM l),
f AS (SELECT conv_id, turn, any_value(role) AS role, count(*) FILTER (WHERE level > 0) AS n_quoted, max(level)::BIGINT AS max_level,
  regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE level = 0 AND NOT intro), ''), '^{_SPACE_SQL}+|{_SPACE_SQL}+$', '', 'g') AS body FROM m GROUP BY conv_id, turn),
k AS (SELECT *, CASE WHEN intro THEN -1 ELSE level END AS lv FROM m),
r0 AS (SELECT *, CASE WHEN lag(lv) OVER w IS DISTINCT FROM lv THEN 1 ELSE 0 END AS opens FROM k WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)),
r AS (SELECT *, sum(opens) OVER (PARTITION BY conv_id, turn ORDER BY i) AS run, sum(CASE WHEN plain = '' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS para FROM r0),
p AS (SELECT conv_id, turn, run, para, string_agg(plain, ' ' ORDER BY i) AS txt FROM r WHERE plain <> '' GROUP BY ALL), w AS (SELECT conv_id, turn, run, string_agg(plain, ' ' ORDER BY i) AS txt FROM r WHERE plain <> '' GROUP BY ALL),
x AS (SELECT r.conv_id, r.turn, r.lv, r.level, r.plain, unnest([r.plain, p.txt, w.txt]) AS key FROM r JOIN p USING (conv_id, turn, run, para) JOIN w USING (conv_id, turn, run) WHERE r.plain <> ''),
q AS (SELECT conv_id, turn, plain, key, min(lv) AS level FROM x WHERE lv > 0 GROUP BY ALL),
s AS (SELECT DISTINCT conv_id, turn, key FROM x WHERE lv = 0 UNION SELECT conv_id, turn, plain FROM x WHERE level = 0),
b AS (SELECT conv_id, turn, source, plain, min(level) AS level FROM (SELECT q.*, s.turn AS source FROM q JOIN s ON q.conv_id = s.conv_id AND q.key = s.key AND s.turn < q.turn) GROUP BY ALL),
c AS (SELECT conv_id, turn, source, count(*) AS n, min(level) AS level FROM b GROUP BY ALL),
z AS (SELECT conv_id, turn, arg_max(source, (-level, n, source)) AS reply_to FROM c GROUP BY ALL), nl AS (SELECT conv_id, turn, count(DISTINCT plain) AS n_linked FROM b GROUP BY ALL),
t AS (SELECT DISTINCT conv_id, reply_to AS turn, reply_to AS root_turn, 0 AS depth, [reply_to] AS path FROM z WHERE NOT EXISTS (SELECT 1 FROM z y WHERE y.conv_id = z.conv_id AND y.turn = z.reply_to)
  UNION ALL SELECT z.conv_id, z.turn, t.root_turn, t.depth + 1, t.path || [z.turn] FROM t JOIN z ON z.conv_id = t.conv_id AND z.reply_to = t.turn),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, root_turn ORDER BY path) - 1 AS position FROM t)
SELECT f.conv_id, f.turn, f.role, f.body, f.n_quoted, f.max_level, coalesce(nl.n_linked, 0) AS n_linked, z.reply_to, coalesce(o.root_turn, f.turn) AS root_turn, coalesce(o.depth, 0)::INT AS depth, coalesce(o.position, 0) AS position
FROM f LEFT JOIN z USING (conv_id, turn) LEFT JOIN nl USING (conv_id, turn) LEFT JOIN o USING (conv_id, turn)
"""
