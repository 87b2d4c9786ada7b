"""Corpus operators on what a bound or a filter would lose."""

import os
import threading

from cuelake.llm import common, license_notices, mixing, pii_bootstrap, quote_links, secret_crf
from tests.oracle import connect, differences


def test_pii_second_step(spark):
    """An identifier whose only pattern has no seeds is found through identifiers that a seed pattern gave."""
    rows = [(k, f"please write to user{k}@mail.example.com today or so") for k in range(200)]
    rows += [(1000 + k, f"please write to member-{k}x7 today or so") for k in range(1, 6)] + [(2000 + k, f"the account holder member-{k}x7 paid for it") for k in range(1, 6)]
    rows += [(3000, "the account holder member-9x9 paid for it"), (3001, "we sold item-9x9 last year again")]
    got = {r["doc_id"]: r["n_ctx"] for r in pii_bootstrap.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] == 1 for k in (1001, 2005, 3000)) and got[3001] == 0


def replies(spark, rows):
    df = spark.createDataFrame([(1, k, "u", t) for k, t in enumerate(rows, 1)], "conv_id long, turn long, role string, text string")
    return {r["turn"]: (r["reply_to"], r["root_turn"], r["depth"], r["n_linked"]) for r in quote_links.link_quotes(df).collect()}


def test_quotes_of_later_turns(spark):
    """A line that several turns say goes to the one that says most of the quote, else to the latest before it."""
    got = replies(spark, ["the same line", "one", "> one\nwell", "Hi all\nthe plan is good", "Hi all\nthe plan is bad", "Hi all\nwho knows", "the same line", "> the same line\nyes", "> Hi all\n> the plan is bad\nno", "the same line"])
    assert got[8][0] == 7 and got[9] == (5, 5, 1, 2)


def test_quotes_wrapped_anew(spark):
    got = replies(spark, ["A long first paragraph that a client\nwill wrap\n\nno", "Ann wrote:\n> A long first\n> paragraph that a client will\n> wrap\nfine", "ok", "> ok\nthanks", "Ann wrote:\n> A long first paragraph\n> that a client will wrap\n>\n> no\nwhy"])
    assert [got[k][0] for k in (2, 4, 5)] == [1, 3, 1] and got[5][3] == 3


def test_field_despite_prose_about_secrets(spark):
    """Few real secrets among much prose that names tokens and secrets still give a field."""
    key = "0123456789abcdef"
    rows = [(k, f"the token of note {k} is no secret") for k in range(4000)] + [(5000 + k, f"config {k} password = Zq9{key}{k}") for k in range(3)]
    assert secret_crf.fit(spark.createDataFrame(rows, "doc_id long, text string")) is not None


def test_base_match_in_columns(spark, sf_dir):
    cases = ["token:secret:abcdefgh", "password = 'abcdefgh", "api_key=abcdefg", "APIKEY: abcdefgh", "AKIA" + "A" * 11, "AKIA" + "A" * 12, "f" * 31, "f" * 32, "", None, "token==abcdefg", "ſecret=abcdefgh", "toKen=abcdefgh"]
    df = spark.createDataFrame([(t,) for t in cases], "text string").union(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text"))
    got = df.select("text", secret_crf.has_base_match(df["text"]).alias("b")).collect()
    assert all(r["b"] == bool(secret_crf.base_spans(r["text"] or "")) for r in got)


def test_mixing_returns_documents(spark, sf_dir):
    out = mixing.op8_poisson_mixing(spark, sf_dir)
    assert {"text", "lang", "n_chars", "copy", "order_key"} <= set(out.columns)
    assert differences(out, connect(sf_dir), mixing.OP8_SQL) == ""


def test_notice_before_a_cleaner_copy():
    line = "relessed undr the mit license released under the mit license"
    assert [(s, e) for _, s, e, _ in license_notices.find_notices(line)] == [(0, 29), (30, 60)]


def test_written_tables_belong_to_their_thread(spark):
    """Two pipelines in one driver: each deletes its own tables at its end, and none of the other's."""
    inside, ended = threading.Barrier(2, timeout=60), threading.Event()
    counts = {}

    def run(name, first):
        with common.scratch(spark):
            table = common.stored(spark.range(5))
            with common.scratch(spark):
                inner = common.stored(spark.range(3)).inputFiles()[0]
            counts[name, "inner"] = os.path.exists(inner.removeprefix("file://"))
            inside.wait()
            if not first:
                ended.wait(60)
            counts[name] = table.count()
        counts[name, "after"] = os.path.exists(table.inputFiles()[0].removeprefix("file://"))
        ended.set()

    threads = [threading.Thread(target=run, args=(n, n == "a")) for n in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert counts == {"a": 5, "b": 5, ("a", "inner"): False, ("b", "inner"): False, ("a", "after"): False, ("b", "after"): False}
