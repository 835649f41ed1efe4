"""WAND against scoring every pair, odd rows, blocks and shards, and SQL on a small fixture."""

import random
import re
from array import array
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from quillstone.llm.lexical_search import SEARCH_SQL, TERM, SearchParams, search, terms, wand, weight

ROWS = "doc_id long, text string"


def plain_terms(text):
    return re.findall(TERM, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    own = [(d, Counter(plain_terms(t))) for d, t in docs if plain_terms(t)]
    n_docs, n_terms = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(plain_terms(t))
    out = []
    for i, words in asked.items():
        scored = []
        for d, c in own:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_terms
            s = sum(weight(n_docs, df[t]) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in words if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(i, r, None if no else d, -s) for r, (s, no, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def got(spark, docs, items, p=SearchParams()):
    frame = spark.createDataFrame(docs, ROWS).repartition(3)
    return sorted((tuple(r) for r in search(frame, spark.createDataFrame(items, "item_id long, text string"), p).collect()), key=str)


def corpus(seed, n=300):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Ünder", "ÜNDER", "x-y", "日本", "3rd"]
    text = lambda least, most: " ".join(r.choice(words[: r.choice((5, 20, 65))]) for _ in range(r.randint(least, most)))
    docs = [(i, text(1, 80)) for i in range(n)] + [(7, text(3, 9)), (8, "w1 W1 w2"), (8, "w1 W1 w2"), (None, "w1 w1 w2"), (None, "w1 w1 w2"), (401, None), (402, ""), (403, "--- !!"), (-5, "w3 w4")]
    return docs, [(i, text(1, 25)) for i in range(12)] + [(3, "w40 w41"), (90, None), (91, "..."), (92, "absent"), (None, "w5"), (93, "W1 w1 w1, w2")]


def test_terms_of_bytes_are_those_of_the_pattern():
    for text in ["A-b C_d É É x 3,4 \x00\x7f日本 ÀÇ Iİ", "", "...", "Zz\n\tZZ"]:
        assert [t.decode() for t in terms(text.encode())] == plain_terms(text)


def test_wand_is_the_best_k_of_all():
    r = random.Random(3)
    for _ in range(300):
        lists, docs, impacts, total = [], array("i"), array("q"), Counter()
        for _ in range(r.randint(0, 6)):
            own = sorted(r.sample(range(40), r.randint(1, 25)))
            parts = [r.randint(1, 4) for _ in own]
            lists.append((len(docs), len(docs) + len(own), max(parts)))
            docs.extend(own)
            impacts.extend(parts)
            total.update(dict(zip(own, parts, strict=True)))
        assert wand(docs, impacts, lists, 5) == sorted(((s, d) for d, s in total.items()), key=lambda x: (-x[0], x[1]))[:5]


def test_results_are_those_of_scoring_every_pair(spark):
    docs, items = corpus(1)
    want = brute(docs, items)
    assert got(spark, docs, items) == want
    # many shards, many blocks of items, few salts: nothing changes
    assert got(spark, docs, items, SearchParams(block_bytes=200, shard_postings=300, salts=2)) == want


def test_sql_gives_the_same_rows(spark):
    docs, items = corpus(2)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    assert sorted(con.execute(SEARCH_SQL).fetchall(), key=str) == brute(docs, items)


def test_equal_scores_go_to_smaller_ids_over_shards(spark):
    docs = [(i, "same text here") for i in range(400, 0, -1)]
    out = got(spark, docs, [(1, "text")], SearchParams(shard_postings=50, salts=3))
    assert [(r, d) for _, r, d, _ in sorted(out, key=lambda x: x[1])] == [] or sorted(d for *_, d, _ in out) == list(range(1, 11))
    docs.append((1000, "other words"))
    out = sorted(got(spark, docs, [(1, "text")], SearchParams(shard_postings=50, salts=3)), key=lambda x: x[1])
    assert [(r, d) for _, r, d, _ in out] == [(i, i) for i in range(1, 11)]


def test_a_very_long_text_is_searched_whole(spark):
    docs = [(1, "filler " * 300_000 + "needle"), (2, "filler needle"), (3, "hay"), (4, "stack")]
    assert got(spark, docs, [(1, "Needle")]) == brute(docs, [(1, "Needle")])


def test_empty_tables_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 3)], "doc_id long, text string, rank string, n long")
    items = spark.createDataFrame([(1, "a", "y")], "item_id long, text string, doc_id string")
    assert search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]
    assert search(docs.limit(0), items).count() == 0 and search(docs, items.limit(0)).count() == 0
    assert dict(search(docs, items).dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert search(docs.withColumn("text", F.lit(None).cast("string")), items).count() == 0
