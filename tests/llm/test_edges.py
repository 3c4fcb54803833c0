"""Nulls, empty and very long texts, repeated rows, clashing columns and empty tables for every operator."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from canopygrid.llm import chat, decontaminate, html_text, linededup, neighbours, packing, quality, shingle_join, toxicity, urls
from canopygrid.llm.queries import tokenizer

LONG = "lorem ipsum dolor sit amet " * 60_000
ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (4, "one two"), (None, "one two"), (None, None), (5, LONG), (6, LONG + "end"), (7, "É ñ 漢字 \x00 '’ <|endoftext|>")]
SCHEMA = "doc_id long, text string"
CLASHES = "score line node rank keeper ids items marks offset length start piece sequence_id template n_words".split()


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({x: F.lit(1) for x in CLASHES})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([("a", "one two"), (None, "one two"), ("b", None), ("c", ""), ("c", "ipsum dolor sit amet lorem ipsum dolor sit amet lorem ipsum")], "item_id string, text string")


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(4, 0), (5, 1), (5, 0), (9, 1), (None, 1), (6, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    found = rows(quality.score(docs, model))
    assert len(found) == len(ROWS) and all(0 <= r["score"] <= 1 for r in found)
    blank = {r["score"] for r in found if r["doc_id"] in (1, 2, 3)}
    assert len(blank) == 1
    assert quality.score(empty, model).count() == 0
    none = quality.train(docs, labels.limit(0))
    assert {r["score"] for r in rows(quality.score(docs, none))} == {0.5}
    kept = quality.accepted(docs, none, threshold=0.5)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)
    assert quality.accepted(docs, none).count() == 0


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(4, 0), (5, 0), (9, 1), (None, 1), (6, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert {r["score"] for r in rows(toxicity.score(docs, model))} == {0.0}
    assert toxicity.with_features(docs.select("doc_id", "text"), model.lexicon).count() == len(ROWS)
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.train(empty, labels.limit(0)).trees is None


def test_html(spark, empty):
    deep = "<div>" * 30_000 + "x" + "</p></table>" * 10
    pages = spark.createDataFrame([(1, None), (1, ""), (None, "<p>a<p>b"), (2, deep), (2, deep), (3, "a < b &amp; c <br/> d</div>")], "page_id long, html string")
    found = rows(html_text.extract(pages.withColumn("text", F.lit("clash"))))
    assert sorted((r["page_id"] or 0, r["text"]) for r in found) == [(0, "a\n\nb"), (1, ""), (1, ""), (2, "x"), (2, "x"), (3, "a < b & c\nd")]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_neighbours(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (100, [1.0, 0.0])]
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumns({x: F.lit(1) for x in ("block", "score", "rank", "label")})
    found = [tuple(r) for r in neighbours.search(table, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    root = 2**0.5
    # Row 1 stands twice and counts once for each query.
    assert found == [(0, 1, 1, 0.0), (0, 2, 100, 0.0), (0, 3, 2, root), (100, 1, 0, 0.0), (100, 2, 1, 0.0), (100, 3, 2, root)]
    assert neighbours.search(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert neighbours.search(table, F.col("vec_id") == 77).count() == 0


def test_shingle_join(docs, empty):
    found = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in rows(shingle_join.join(docs))), key=str)
    assert [r for r in found if r[0] in (1, 2, 3)] == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]
    assert [r for r in found if r[0] == 4] == [(4, 1, 4), (4, 1, 4)]
    assert sorted((r[1], r[2] or 0) for r in found if r[0] == 0) == [(0, 0), (1, 4)]
    assert [r for r in found if r[0] in (5, 6)] == [(5, 5, 5), (6, 6, 5)]
    assert shingle_join.join(empty).count() == 0
    kept = shingle_join.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in rows(kept)) == [0, 0, 1, 2, 3, 4, 4, 5, 7]


def test_chat(spark):
    data = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, "assistant", "\\<|im_end|>\n\\n"), (None, None, None, None), (2, None, "a\nb\\<|", "\\\\<\\|"), (3, 0, "user", ""), (3, 0, "user", "")]
    table = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("node", F.lit(1))
    nodes, leaves = chat.tree(table, tokenizer("byte_bpe_50k.json"))
    found = {r["conv_id"]: r for r in rows(chat.digests(chat.read_back(nodes, leaves)))}
    sha = lambda turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert found[1]["turns_sha256"] == sha([("user", ""), ("", "x"), ("assistant", "\\<|im_end|>\n\\n")]) and found[1]["loss_chars"] == 14
    assert found[None]["turns_sha256"] == sha([("", "")])
    assert found[2]["turns_sha256"] == sha([("a\nb\\<|", "\\\\<\\|")])
    assert found[3]["n_turns"] == 2
    nodes, leaves = chat.tree(table.limit(0), tokenizer("byte_bpe_50k.json"))
    assert chat.digests(chat.read_back(nodes, leaves)).count() == 0


def test_shared_turns_stand_once(spark):
    data = [(k, t, "user" if t % 2 == 0 else "assistant", f"turn {t}" if t < 2 else f"turn {t} of {k}") for k in range(40) for t in range(4)]
    table = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    nodes, leaves = chat.tree(table, tokenizer("byte_bpe_50k.json"))
    kept = sorted(rows(nodes), key=lambda r: r["first_token"])
    assert len(kept) == 2 + 40 * 2 and leaves.count() == 40
    at = 0
    for r in kept:
        # Gapless, parents first; positions count the ancestors' tokens.
        assert r["first_token"] == at and r["intervals"][-1] == (at, at + r["n_tokens"]) and len(r["ids"]) == r["n_tokens"]
        assert r["first_position"] == sum(i.end - i.start for i in r["intervals"][:-1])
        at += r["n_tokens"]


def test_long_conversations_follow_few_runs(spark):
    """Conversations that leave a long one at some turn: intervals merge, places are gapless, texts come back."""
    long = [(0, t, "user" if t % 2 == 0 else "assistant", f"t{t % 7}") for t in range(400)]
    left = [(k, t, r, x if t < 40 * k else f"{x} of {k}") for k in range(1, 9) for _, t, r, x in long[: 40 * k + 30]]
    short = [(10, t, r, x) for _, t, r, x in long[:100]]
    table = spark.createDataFrame(long + left + short, "conv_id long, turn long, role string, text string")
    nodes, leaves = chat.tree(table, tokenizer("byte_bpe_50k.json"))
    kept = sorted(rows(nodes), key=lambda r: r["first_token"])
    assert len(kept) == 400 + 8 * 30
    by_name, at = {r["node"]: r for r in kept}, 0
    for r in kept:
        assert r["first_token"] == at and r["intervals"][-1] == (at, at + r["n_tokens"]) and len(r["intervals"]) <= 11
        at += r["n_tokens"]
        above = by_name.get(r["parent"])
        seen = {k for start, end in r["intervals"][:-1] for k in range(start, end)}
        assert len(seen) == r["first_position"]
        assert seen == ({k for start, end in above["intervals"] for k in range(start, end)} if above else set())
    sha = lambda conv: hashlib.sha256("".join(f"{r}\n{x}\n" for k, _, r, x in long + left + short if k == conv).encode()).hexdigest()
    found = rows(chat.digests(chat.read_back(nodes, leaves)))
    assert {r["conv_id"]: r["turns_sha256"] for r in found} == {k: sha(k) for k in (*range(9), 10)}


def test_urls(spark):
    rules = [urls.host_rule(v, t) for v, t in (("block", "com/en/"), ("allow", "example.com/en/7"))]
    data = [(1, None, "", "", None, "allow"), (1, "", "", "", None, "allow"), (2, "no scheme/en/", "", "", None, "allow"), (3, "HTTP://A.Com/en/x?y#z", "a.com", "/en/x", "com/en/", "block"), (3, "http://xcom/en/", "xcom", "/en/", None, "allow"), (4, "x://example.com/en/70", "example.com", "/en/70", "example.com/en/7", "allow"), (5, "x://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"), (6, "x://com?/en/", "com", "", None, "allow"), (7, "x://org/a.com/en/", "org", "/a.com/en/", None, "allow"), (8, "x://com/en/" + "a" * 100_000, "com", "/en/" + "a" * 100_000, "com/en/", "block"), (None, "x://com/EN/", "com", "/EN/", None, "allow")]
    table = spark.createDataFrame([r[:2] for r in data], "page_id long, url string").withColumn("verdict", F.lit(1))
    found = rows(urls.judge(table, rules))
    assert sorted(map(str, (tuple(r.values()) for r in found))) == sorted(str((r[0], *r[2:])) for r in data)
    assert urls.judge(table.limit(0), rules).count() == 0
    assert {r["verdict"] for r in rows(urls.judge(table, [], "block"))} == {"block"}


def test_many_rules_span_words():
    rules = [urls.host_rule("block", f"h{i}.org/p{i}") for i in range(200)] + [urls.Rule("block", "glob", "*.a?c.*/x*y")]
    automaton = urls.Automaton(rules)
    assert automaton.winners([b".h7.org/p7/z", b".s.h199.org/p199", b".h7.org/p8", b".abc.net/xzzy", b".abc.net/q", b".a/c.net/xy"]).tolist() == [7, 199, -1, 200, -1, -1]


def test_line_dedup(docs, empty):
    kept = linededup.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)
    assert sorted((r["text"] or "") for r in rows(kept)) == sorted((t or "") for _, t in ROWS)
    assert linededup.deduplicated(empty).count() == 0 and linededup.report(empty).count() == 0
    assert linededup.report(docs).count() == len(ROWS)


def test_decontamination(docs, empty, items):
    found = {(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in rows(decontaminate.report(docs, items))}
    assert {(1, 0, 0, 0), (2, 0, 0, 0), (4, 2, 2, 1), (None, 2, 2, 1), (None, 0, 0, 0), (5, 300_000, 299_996, 1)} <= found
    assert decontaminate.report(empty, items).count() == 0
    assert not any(r["contaminated"] for r in rows(decontaminate.report(docs, items.limit(0))))
    kept = decontaminate.cleaned(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in rows(kept)) == [0, 1, 2, 3, 7]
    # Blocks of one window each find the same.
    assert sorted(map(str, rows(decontaminate.report(docs, items, most=1)))) == sorted(map(str, rows(decontaminate.report(docs, items))))
    assert sorted(map(str, rows(decontaminate.cleaned(docs, items, most=1)))) == sorted(map(str, rows(kept)))


def test_packing(docs, empty):
    found = rows(packing.pack(packing.pieces(docs, tokenizer("word_bpe_49k.json"))))
    sequences = {}
    for r in found:
        assert 1 <= r["length"] <= 4096 and r["start"] == r["piece"] * 4096
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert sum(r["piece"] == 0 for r in found) == len(ROWS)
    assert packing.pack(packing.pieces(empty, tokenizer("word_bpe_49k.json"))).count() == 0


def test_pipeline_on_an_empty_table(spark, empty, sf_dir):
    docs = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
