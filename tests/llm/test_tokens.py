"""Encoding, resampling to a target and alignment of vocabularies, against the libraries and brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cuelake.llm import queries, target_resampling, token_alignment, word_bpe

DOC = "doc_id long, text string, lang string, source string, ids string, score string, rank int, chunk string, place string, stripe int, part string"
LONG = ("Word " * 20_000) + "x" * 5_000 + " " * 20_000 + "９" * 500 + "\n" * 12_000 + "'" * 300


def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing names."""
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "   \n\t ", "en", "a"), (4, LONG, "en", "a"), (None, "some text here", "en", "b")]
    rows += [(5, "The same row, twice over.", "en", None)] * 2 + [(6, "😀 naïve ünïcode — text ΑΣ", "xx", "c"), (7, "\x00 nul \x00 \x85 odd 　 ▁<s> <0x0A> <|endoftext|>", "en", "a")]
    return spark.createDataFrame([(*r, "i", "s", 1, "c", "p", 2, "q") for r in rows], DOC)


def empty(spark):
    return spark.createDataFrame([], DOC)


def docs_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# --- 11


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def brute_round_trip(library, docs):
    out = []
    for i, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        out.append((i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    return Counter(out)


def test_round_trip(spark, sf_dir, word_library):
    got = word_bpe.op11_word_bpe(spark, sf_dir)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert Counter(map(tuple, got.collect())) == brute_round_trip(word_library, docs_of(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def test_round_trip_odd(spark, word_library):
    got = word_bpe.decode(word_bpe.encode(odd(spark))).collect()
    want = {(i, t): word_library.encode(t or "", add_special_tokens=False).ids for i, t in docs_of(odd(spark))}
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == Counter((i, np.array(want[i, t], dtype="<u4").tobytes()) for i, t in docs_of(odd(spark)))
    assert all(r["decoded"] == word_library.decode(np.frombuffer(r["ids"], "<u4").tolist(), skip_special_tokens=False) for r in got)
    assert word_bpe.decode(word_bpe.encode(empty(spark))).count() == 0
    assert word_bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids binary")).first()["decoded"] == ""


def test_codec_on_seeded_texts(word_library):
    rnd, own = random.Random(11), word_bpe.Codec(public_tokenizers.path("word_bpe_49k.json"))
    everything = [chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000]
    mixed = "aA bB'sS'tT 12\x1c\x1f\x0b\x85  Σσİ́è <|endoftext|>\n.,!?#é"
    for n in range(4_000):
        pool = (everything, mixed, everything[32:1200], everything[:128])[n % 4]
        text = "".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 60)))
        if n % 10 == 0:
            text = f"{text[:9]}<|endoftext|>{text[9:]}<|startoftext|>"
        ids = word_library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == np.array(ids, dtype="<u4").tobytes(), repr(text)
        assert own.decode(own.encode(text)) == word_library.decode(ids, skip_special_tokens=False)


def test_both_ways_to_merge(word_library):
    """Scans over short words and the heap for long ones merge alike; boundaries tell the parts' places."""
    rnd, own = random.Random(12), word_bpe.Codec(public_tokenizers.path("word_bpe_49k.json"))
    for _ in range(200):
        word = "".join(rnd.choice("abcdetinghousr") for _ in range(rnd.randrange(1, 900))).encode()
        bounds, ids = own.parts(word)
        assert ids == own.parts_of_long(word) == word_library.encode(word.decode(), add_special_tokens=False).ids
        pieces = [word[a:b].decode() for a, b in zip(bounds, [*bounds[1:], len(word)])]
        assert [own.tokens[i].removesuffix("</w>") for i in ids] == pieces


# --- 12

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_features(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute_resampling(docs, target, percent=5, least=20):
    docs = [(i, *brute_features(t)) for i, t in docs]
    s, t = Counter(b for *_, f in docs for b in f), Counter(b for x in target for b in brute_features(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000)))) for b in range(10_000)]
    rows = []
    for i, n, f in docs:
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], math.inf if r[0] is None else r[0], r[2], r[3]))
    drawn = able[: percent * len(able) // 100]
    left = Counter(rows) - Counter(drawn)
    return Counter({(*r[:1], *r[2:], k): 1 for k, r in enumerate(drawn, 1)}) + Counter({(*r[:1], *r[2:], None): n for r, n in left.items()})


def test_target_resampling(spark, sf_dir):
    got = target_resampling.op12_target_resampling(spark, sf_dir)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet").collect()
    want = brute_resampling([(r["doc_id"], r["text"]) for r in read("documents")], [r["text"] for r in read("benchmark")])
    assert Counter(map(tuple, got.collect())) == want


@pytest.mark.parametrize("percent", [0, 5, 60, 100])
def test_target_resampling_odd(spark, percent):
    """Repeats, null ids and ties at the last place, with words enough to be drawn."""
    many = "one two three four five six seven eight nine ten " * 3
    rows = [(r["doc_id"], r["text"]) for r in odd(spark).collect()] + [(8, many)] * 7 + [(None, many)] * 3 + [(8, many + "eleven"), (9, many)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([("One two three.",), (None,), ("",)], "text string")
    got = target_resampling.resample_to_target(docs, target, percent).drop("n_words")
    assert Counter(map(tuple, got.collect())) == brute_resampling(rows, ["One two three.", None, ""], percent)


def test_target_resampling_empty(spark):
    none = spark.createDataFrame([], "text string")
    assert target_resampling.resample_to_target(empty(spark), none).count() == 0
    got = target_resampling.resample_to_target(odd(spark), none, 50)
    assert Counter(map(tuple, got.drop("n_words").collect())) == brute_resampling(docs_of(odd(spark)), [], 50)


def test_draw(spark, monkeypatch):
    """Few score ranges and few copies a row, so that every step of the draw has more than one part."""
    monkeypatch.setattr(target_resampling, "RANGES", 3)
    monkeypatch.setattr(target_resampling, "COPIES", 2)
    rnd = random.Random(4)
    rows = [(rnd.randrange(30), rnd.choice([-5, 0, 1, 1, 2, 9])) for _ in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, score long")
    for places in (0, 1, 17, 150, 299, 300, 900):
        want = [(*r, k) for k, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[0]))[:places], 1)]
        assert sorted(map(tuple, target_resampling.draw(df, places).collect()), key=lambda r: r[2]) == want


# --- 13


def brute_alignment(docs):
    a_side = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte_of = {s: b for b, s in enumerate(word_bpe.byte_symbols())}

    def b_bytes(i):
        m = re.fullmatch("<0x(..)>", b_side.id_to_piece(i))
        return bytes([int(m[1], 16)]) if m else b_side.id_to_piece(i).replace("▁", " ").encode()

    def ends(parts):
        out, at = [], 0
        for p in parts:
            at += len(p)
            out.append(at)
        return out

    rows, counts = [], Counter()
    for i, text in docs:
        a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        a_parts, b_parts = [bytes(byte_of[c] for c in a_side.id_to_token(x)) for x in a], [b_bytes(x) for x in b]
        if not (b"".join(a_parts) == b"".join(b_parts) == (" " + (text or "")).encode()):
            a, b, a_parts, b_parts = [], [], [], []
        a_ends, b_ends = ends(a_parts), ends(b_parts)
        both = sorted(set(a_ends) & set(b_ends))
        groups = []
        for lo, hi in zip([0, *both], both):
            inside = lambda ids, at: [x for x, e in zip(ids, at) if lo < e <= hi]  # noqa: B023, E731
            groups.append((inside(a, a_ends), inside(b, b_ends)) if len(text) < 2_000 else None)
        links, j = [], 0
        for x, e, p in zip(a, a_ends, a_parts):
            while j and b_ends[j - 1] > e - len(p):
                j -= 1
            while b_ends[j] <= e - len(p):
                j += 1
            k = j
            while k < len(b) and b_ends[k] - len(b_parts[k]) < e:
                links.append((b[k], x))
                k += 1
        counts.update(links)
        written = ";".join(f"{','.join(map(str, g[0]))}|{','.join(map(str, g[1]))}" for g in groups) if groups and None not in groups else None
        rows.append((i, a, b, len(both), links, written))
    best = defaultdict(int)
    for (b, _), n in counts.items():
        best[b] = max(best[b], n)
    return rows, counts, best


def held(got, docs):
    rows, counts, best = brute_alignment(docs)
    want = Counter((i, len(a), len(b), n, len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links)) for i, a, b, n, links, _ in rows)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    assert Counter(tuple(r[c] for c in names) for r in got) == want
    shas = {(i, hashlib.sha256(w.encode()).hexdigest()) for i, a, *_, w in rows if w}
    assert shas <= {(r["doc_id"], r["groups_sha256"]) for r in got} and all((r["groups_sha256"] == "") == (r["n_a"] == 0) for r in got)
    return counts, best


def test_alignment(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = token_alignment.op13_token_alignment(spark, sf_dir)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    held(got.collect(), docs_of(docs))


def test_alignment_in_parts(spark, sf_dir):
    """Small chunks, narrow stripes and two chunks to a task: several rounds of sums, and stripes dealt over tasks."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 40")
    got = token_alignment.align(docs, with_groups=True, stripe=40, chars=30_000, chunk_docs=5, fan=2, scored_chunks=2).collect()
    held(got, docs_of(docs))
    assert all(hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] for r in got if r["groups"])


def test_alignment_odd(spark):
    got = token_alignment.align(odd(spark)).collect()
    held(got, docs_of(odd(spark)))
    assert {r["doc_id"] for r in got if not r["n_a"]} == {1, 2, 7}  # 7 holds the sign that stands for a space
    assert token_alignment.align(empty(spark)).count() == 0


def test_pair_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 20")
    got = token_alignment.pair_counts(token_alignment.link_documents(docs)).collect()
    _, counts, best = brute_alignment(docs_of(docs))
    assert {(r["b_id"], r["a_id"]): r["count"] for r in got} == dict(counts)
    assert all(r["best"] == (r["count"] == best[r["b_id"]]) for r in got)


def test_registered():
    assert {"op11_word_bpe", "op12_target_resampling", "op13_token_alignment"} <= set(queries.QUERIES)
