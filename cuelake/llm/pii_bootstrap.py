"""Personal data: fixed patterns, and a bootstrapped search for identifiers that no pattern knows.

Seeds are the matches of the fixed patterns. Every word with a digit or an at-sign is an instance. Its lexical
patterns are the two words before it, the two after it, and the one before with the one after, in lower case;
words with a digit or an at-sign count as "#" there, and the ends of a text as words of their own. A pattern counts
from a few distinct trusted instances on, seeds or found through other patterns. Patterns and instances form
a graph, scored in rounds: a pattern is as trusted as the share of its distinct instances that are trusted, an
instance is trusted unless all its patterns are wrong about it. Instances that only patterns vouch for, with high
confidence, are reported as kind ctx.

All of it is built-in functions and joins. Texts are read once; what moves is the matches. In the graph, patterns
and instances are 64-bit hashes, so that no word is too long for it. A pattern or an instance that very many
others go with (the same number in a third of all texts) is dealt over several tasks in each join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm.common import SPACE, join_unique, let, row_key, words
from cuelake.session import cut, read_table

# The base kinds, in the order in which equal starts are listed. Possessive quantifiers and
# the look-behinds change no match; they keep long runs without a match from being tried at every place.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text with a match of a kind must hold.
HINTS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: Words with a digit or an at-sign.
INSTANCE = rf"(?<![^{SPACE}])[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+"
ROUNDS = 3
#: A pattern's share is taken of so many instances more than it has, so that few do not convince.
DOUBT = 2.0
#: Confidence from which a pattern speaks for its instances, and from which an instance is reported.
MIN_PATTERN, MIN_INSTANCE = 0.6, 0.6
#: Distinct trusted instances, seeds or found in an earlier round, that a pattern must introduce.
MIN_SEEDS = 3
_BLOCK = 256


def running_offsets(lengths: Column) -> Column:
    """The sum of all earlier elements for each element, in blocks so that long arrays stay cheap."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")), lambda b: F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)))
    none = F.array().cast("array<int>")

    def sums(values: Column) -> Column:  # (total, sums before each element)
        start = F.struct(F.lit(0).alias("s"), none.alias("a"))
        return F.aggregate(values, start, lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["a"], F.array(acc["s"])).alias("a")))

    def joined(parts: Column) -> Column:
        before = sums(F.transform(parts, lambda p: p["s"]))["a"]
        return F.flatten(F.zip_with(parts, before, lambda p, o: F.transform(p["a"], lambda v: v + o)))

    return F.when(F.size(lengths) > 0, let(F.transform(blocks, lambda b: sums(b)), joined)).otherwise(none)


def matches(text: Column, pattern: str) -> Column:
    """(start, end, match, before) of the leftmost non-overlapping matches: before is the text since the
    last one. Built from what lies between the matches and the matches themselves."""

    def placed(m: Column) -> Column:
        def ends(parts: Column) -> Column:
            lengths = F.zip_with(F.slice(parts, 1, F.size(m)), m, lambda p, x: F.length(p) + F.length(x))
            starts = running_offsets(lengths)
            return F.zip_with(
                F.arrays_zip(starts.alias("at"), F.slice(parts, 1, F.size(m)).alias("before")), m,
                lambda p, x: F.struct((p["at"] + F.length(p["before"])).alias("start"), (p["at"] + F.length(p["before"]) + F.length(x)).alias("end"), x.alias("match"), p["before"].alias("before")),
            )

        return F.when(F.size(m) > 0, let(F.split(text, pattern, -1), ends)).otherwise(F.array().cast("array<struct<start:int,end:int,match:string,before:string>>"))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    at = F.sequence(F.lit(0), F.length(digits) - 1)
    value = lambda i: F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")  # noqa: E731  from the right
    add = lambda i: F.when(i % 2 == 0, value(i)).otherwise(F.when(value(i) > 4, 2 * value(i) - 9).otherwise(2 * value(i)))
    return F.aggregate(at, F.lit(0), lambda s, i: s + add(i)) % 10 == 0


#: What a match of a kind must also fulfil.
CHECKS = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("long") <= 255, F.lit(False))),
    "card": lambda m: let(_digits(m), lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(False)),
    "phone": lambda m: F.length(_digits(m)).between(10, 15),
}


def base_spans(text: Column) -> Column:
    """Array of (start, kind number, end, match) of the fixed patterns, sorted."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int,match:string>>")

    def of(k: int, kind: str) -> Column:
        good = F.filter(matches(text, PATTERNS[kind]), lambda m: CHECKS[kind](m["match"]))
        found = F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"), m["match"].alias("match")))
        return F.when(F.contains(text, F.lit(HINTS[kind])), found).otherwise(none)

    return F.when(text.rlike("[0-9@]"), F.sort_array(F.concat(*(of(k, kind) for k, kind in enumerate(PATTERNS))))).otherwise(none)


def instances(text: Column, spans: Column) -> Column:
    """Array of (start, end, instance, patterns, seed) of the words with a digit or an at-sign.

    The instance hashes the word without punctuation at its ends (of punctuation alone, as it is); patterns are
    three hashes of what stands around it. It is a seed if it overlaps a base span.
    """
    lead_marks, tail_marks = r"^[^\p{L}\p{N}@+]+", r"[^\p{L}\p{N}]+\z"

    def of(t: Column) -> Column:  # t: all words, and the places of those that are instances
        all_, places = t["words"], t["places"]

        def beside(k: Column) -> Column:
            near = F.coalesce(F.get(all_, k), F.when(k < 0, "\x02").otherwise("\x03"))
            return F.when(near.rlike("[0-9@]"), "#").otherwise(F.lower(near))

        def one(m: Column, k: Column) -> Column:
            word = m["match"]
            bare = F.regexp_replace(word, lead_marks, "")
            core = F.regexp_replace(bare, tail_marks, "")
            start = m["start"] + F.length(word) - F.length(bare)
            around = let(F.transform(F.array(*(F.lit(d) for d in (-2, -1, 1, 2))), lambda d: beside(k + d)), lambda w: F.array(F.xxhash64(F.lit(1), w[0], w[1]), F.xxhash64(F.lit(2), w[2], w[3]), F.xxhash64(F.lit(3), w[1], w[2])))
            whole = core == ""
            return F.struct(F.when(whole, m["start"]).otherwise(start).alias("start"), F.when(whole, m["end"]).otherwise(start + F.length(core)).alias("end"), F.xxhash64(F.when(whole, word).otherwise(core)).alias("instance"), around.alias("patterns"))

        return F.zip_with(matches(text, INSTANCE), places, one)

    def flagged(i: Column) -> Column:
        seed = F.exists(spans, lambda s: (s["start"] < i["end"]) & (i["start"] < s["end"]))
        return F.struct(i["start"].alias("start"), i["end"].alias("end"), i["instance"].alias("instance"), i["patterns"].alias("patterns"), seed.alias("seed"))

    placed = let(words(text), lambda w: F.struct(w.alias("words"), F.filter(F.transform(w, lambda x, k: F.when(x.rlike("[0-9@]"), k)), lambda k: k.isNotNull()).alias("places")))
    none = F.array().cast("array<struct<start:int,end:int,instance:bigint,patterns:array<bigint>,seed:boolean>>")
    return F.when(text.rlike("[0-9@]"), F.transform(let(placed, of), flagged)).otherwise(none)


def trusted_instances(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """instance, score of what patterns vouch for, from distinct edges (pattern, instance, seed)."""
    # Patterns that introduce no seed cannot gain trust before an instance of theirs does; all stay.
    pairs = cut(edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    seeds = pairs.groupBy("instance").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n"))
    degree = cut(seeds)  # how many patterns each instance goes with
    sizes = cut(pairs.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")))  # and instances each pattern
    scores = degree.where("seed").select("instance", F.lit(1.0).alias("score"))
    for _ in range(rounds):
        # Only instances with a score add to a pattern's sum; how many it has in all is known.
        held = join_unique(pairs.select("pattern", "instance"), scores, ["instance"], degree.select("instance", "n"))
        by = held.groupBy("pattern").agg(F.sum("score").alias("s"), F.count_if(F.col("score") >= MIN_INSTANCE).alias("trusted"))
        by = by.where(F.col("trusted") >= MIN_SEEDS).join(sizes, "pattern")
        strong = cut(by.select("pattern", (F.col("s") / (F.col("n") + DOUBT)).alias("conf")).where(F.col("conf") >= MIN_PATTERN))
        voted = join_unique(pairs.select("pattern", "instance"), strong, ["pattern"], sizes)
        voted = voted.groupBy("instance").agg((1 - F.exp(F.sum(F.log1p(-F.least("conf", F.lit(0.999)))))).alias("vote"))
        both = degree.where("seed").select("instance", F.lit(1.0).alias("score")).unionByName(voted.select("instance", F.col("vote").alias("score")))
        scores = cut(both.groupBy("instance").agg(F.max("score").alias("score")))
    found = scores.join(degree.where("seed").select("instance"), "instance", "left_anti")
    return found.where(F.col("score") >= MIN_INSTANCE).select("instance", "score")


def find_personal_data(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans,
    n_ctx. spans are kind:start:end in code points.

    A null text is empty, and like a blank one has no instances; long texts and words are read whole. Rows that repeat
    are returned as often as they come, with the same spans, and count once in the graph; a null doc_id is kept. Other columns are ignored. No rows give no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), let(text, lambda t: let(base_spans(t), lambda s: F.struct(s.alias("spans"), instances(t, s).alias("instances")))).alias("f"))
    found = cut(own.select("doc_id", "key", F.transform("f.spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))).alias("spans"), F.col("f.instances").alias("instances")))
    each = found.where(F.size("instances") > 0).select("doc_id", "key", F.explode("instances").alias("i")).select("doc_id", "key", "i.*")
    edges = each.select(F.explode("patterns").alias("pattern"), "instance", "seed")
    trusted = cut(trusted_instances(edges, rounds))
    held = join_unique(each.where(~F.col("seed")).select("doc_id", "key", "start", "end", "instance"), trusted.select("instance"), ["instance"])
    extra = held.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", F.lit(len(PATTERNS)).alias("kind"), "end")).alias("extra"))
    extra = extra.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "extra")
    both = found.drop("instances").join(extra, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    names = F.array(*map(F.lit, [*PATTERNS, "ctx"]))
    listed = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(PATTERNS)]
    ctx = F.coalesce("extra", F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    return both.select("doc_id", *counts, F.sha2(listed(F.col("spans")), 256).alias("base_sha256"), listed(F.sort_array(F.concat("spans", ctx))).alias("spans"), F.size(ctx).cast("long").alias("n_ctx"))


def op7_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
