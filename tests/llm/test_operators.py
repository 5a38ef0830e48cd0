"""The operators as Spark jobs: against brute force or DuckDB, and on odd tables."""

import base64
import hashlib
import math
import random
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_whole_jobs import jaccard_groups
from tracemill.llm import base, decontam, langid, packing, pii, queries, simhash, topk, toxicity, warc

DATA = Path("/root/testdata/sf0.001")
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint", "labels": "doc_id bigint, quality int, toxic int", "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string", "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def words(seed, n, stock=None):
    r = random.Random(seed)
    stock = stock or ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(400)]
    return " ".join(r.choice(stock) for _ in range(n))


def put(spark, folder, **tables):
    for name, schema in SCHEMAS.items():
        rows, more = tables.get(name, []), None
        if isinstance(rows, tuple):
            rows, more = rows
        df = spark.createDataFrame(rows, schema)
        for k, v in (more or {}).items():
            df = df.withColumn(k, F.lit(v))
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls everywhere, repeated rows and ids, ties, long and empty texts, columns with names that operators use."""
    body = words(1, 60)
    item = words(2, 30)
    docs = [
        (0, body, "en", "s", 1), (1, body, "en", None, None), (1, body, "en", None, None), (2, None, "en", "s", 0), (3, "", None, "s", 0), (None, "text of nobody", "de", "s", 3), (None, None, None, None, None),
        (4, "12 34 !!", "fr", "s", 8), (5, "x " + item + " y", "en", "s", 9), (6, item.upper().replace(" ", ", "), None, "s", 9), (7, words(3, 30000), "en", "s", 9), (7, "other text, same id", "en", "s", 9),
        (50, "mail a@b.org and 4111 1111 1111 1111 <|endoftext|>", "en", "s", 9), (51, "vile " + words(4, 20), "en", "s", 9), (52, "vile " + words(5, 20), "en", "s", 9), (53, words(6, 20), "en", "s", 9),
    ]
    labels = [(51, 1, 1), (52, 0, 1), (53, 1, 0), (0, 1, 0), (0, 1, 0), (None, 1, 1), (1, None, None), (999, 1, 1), (4, 0, 0)]
    pages = [(3, "http://a", "<p>x</p>"), (1, "http://b", "<p>x</p>"), (1, "http://b", "<p>x</p>"), (2, None, None), (4, "u", ""), (None, "v", "<p>x</p>"), (None, None, "é\n"), (9, "r\r\nX-Y: z", "y" * 100000)]
    vectors = [(i * 25 if i < 12 else i, [float((i * 7 + k * k) % 11 - 5) for k in range(4)], 0) for i in range(40)]
    vectors += [(100, [1.0, 2.0, 3.0, 4.0], 0), (150, None, 0), (200, [1.0, None, 0.0, 0.0], 0), (250, [float("nan")] * 4, 0), (None, [1.0] * 4, 0), (500, [1.0, 2.0], 0), (550, [], 0), (600, [float("inf"), 0.0, 0.0, 0.0], 0), (33, [0.5] * 4, None), (33, [0.5] * 4, None)]
    clash = {"score": 7, "TOKENS": 1, "row": "r", "mark": 2, "fp": 3, "rank": 4}
    return put(spark, tmp_path_factory.mktemp("odd"), documents=(docs, clash), labels=(labels, {"text": "t", "lang": "l"}), pages=(pages, clash), benchmark=([(1, item), (1, item), (2, None), (3, "too short here"), (None, words(7, 9)), (5, "")], {"q": 1, "doc_id": 5}), embeddings=(vectors, {"v": 1, "mark": 2}))


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return put(spark, tmp_path_factory.mktemp("empty"))


@pytest.mark.parametrize("name", [*queries.QUERIES, "pipeline"])
def test_empty_tables(spark, empty, name):
    run = corpus_pipeline.run if name == "pipeline" else queries.QUERIES[name]
    assert run(spark, empty).collect() == []


@pytest.mark.parametrize("name", ["op1_language_id", "op2_quality", "op4_token_counts", "op5_pii", "op6_simhash", "op8_toxicity"])
def test_odd_tables_give_a_row_each(spark, odd, name):
    rows = queries.QUERIES[name](spark, odd).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in spark.read.parquet(f"{odd}/documents.parquet").collect())


def duck(folder, sql):
    c = duckdb.connect()
    for name in SCHEMAS:
        p = Path(folder) / f"{name}.parquet"
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{p / '*.parquet' if p.is_dir() else p}'")
    cursor = c.execute(sql)
    return [d[0] for d in cursor.description], cursor.fetchall()


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_sql(spark, name):
    names, expected = duck(DATA, queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, str(DATA))
    assert sorted(map(str, expected)) == sorted(str(tuple(r)) for r in got.select(names).collect()) and sorted(names) == sorted(got.columns)


def test_warc_on_odd_pages(spark, odd, tmp_path):
    _, expected = duck(odd, queries.ORACLE_SQL["op3_warc"])
    got = [tuple(r) for r in queries.op3_warc(spark, odd).collect()]
    # A null id revisits the smallest page of its payload; the SQL says the same.
    assert sorted(map(str, got)) == sorted(map(str, expected))
    assert (4, 0, base64.b32encode(hashlib.sha1(b"").digest()).decode(), "revisit", 2, None) in got
    pages = spark.read.parquet(f"{odd}/pages.parquet")
    path = f"file://{tmp_path}/w"
    warc.write_warc(warc.revisits(pages), path)
    every = warc.read_warc(spark, path)
    assert every.where("record_type = 'revisit'").count() == 3 and every.where("record_type = 'response'").count() == 5
    assert {bytes(r.payload).decode() for r in every.where("record_type = 'response'").collect()} == {"<p>x</p>", "", "é\n", "y" * 100000}
    bare = warc.read_warc(spark, path, payload=False)
    assert bare.where("payload is not null").count() == 0 and bare.agg(F.sum("payload_bytes")).first()[0] == every.agg(F.sum("payload_bytes")).first()[0]
    one = warc.read_warc(spark, path, where={"record_id": ["<urn:page:9>", "<urn:page:77>"], "record_type": ["response"]})
    assert one.count() == 1 and "r X-Y: z" in one.first().target_uri
    kinds = warc.read_warc(spark, path, where={"record_type": ["response"]})
    both = kinds.where("payload_bytes = 8").unionByName(kinds.where("payload_bytes = 3")).unionByName(every.where("record_type = 'revisit'"))
    assert both.count() == 6 and every.count() == 8 and kinds.count() == 5 and kinds.where("record_type = 'revisit'").count() == 0
    assert warc.read_warc(spark, f"file://{tmp_path}/none").count() == 0


def test_warc_pushes_filters():
    from pyspark.sql.datasource import EqualTo, In

    reader = warc.WarcReader({"path": "/x", "push": '{"record_type": ["response"], "target_uri": ["a", "b"]}'})
    others = [EqualTo(("payload_bytes",), 3), EqualTo(("record_type",), "revisit")]
    assert list(reader.pushFilters([EqualTo(("record_type",), "response"), *others, In(("target_uri",), ("b", "a"))])) == others
    assert reader.filters == [("record_type", {"response"}), ("target_uri", {"a", "b"})]


def test_small_payloads_stay_responses(spark, rows):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], SCHEMAS["pages"])
    assert rows(warc.revisits(df, least_bytes=3), "record_id", "record_type") == [("<urn:page:1>", "response"), ("<urn:page:2>", "response"), ("<urn:page:3>", "response"), ("<urn:page:4>", "revisit")]


def test_language_query(spark):
    got = queries.op1_language_id(spark, str(DATA)).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.9 and all(0 <= r.score <= 1 for r in got)


def test_language_on_odd_rows(spark, odd):
    got = {r.doc_id: r for r in queries.op1_language_id(spark, odd).collect() if r.doc_id is not None}
    assert got[2].lang_pred == got[3].lang_pred == got[4].lang_pred == "und" and got[2].score == 0 and got[0].lang_pred != "und"
    df = spark.createDataFrame([("abc", "xx"), ("abc", None), (None, "yy")], "text string, lang string")
    model = langid.train(df)
    assert model.languages == ["xx"]
    assert [r[0].lang for r in df.select(langid.identify(model, spark, reject=False)("text")).collect()] == ["xx", "xx", "und"]


def test_training_data_is_bounded(spark, monkeypatch):
    """Thousands of copies of a text, or rows of an id, reach the driver once."""
    got = []
    monkeypatch.setattr(langid, "fit", lambda rows, seed: got.append(rows))
    copies = spark.range(50_000).select(F.when(F.col("id") % 100 < 99, "the same text in every row").otherwise(F.concat(F.lit("text number "), F.col("id").cast("string"))).alias("text"), F.lit("en").alias("lang"))
    langid.train(copies, rows_per_language=20)
    assert 10 < len(got[0]) <= 20
    monkeypatch.setattr(toxicity, "fit", lambda bags, marks, seed: got.append((bags, marks)))
    rows = spark.range(50_000).select((F.col("id") % 300).alias("doc_id"), F.lit("one two three " * 50).alias("text"))
    labels = spark.range(100_000).select((F.col("id") % 400).alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    toxicity.train(rows, labels, rows_per_class=30, features_a_row=5)
    bags, marks = got[1]
    assert 20 < len(bags) == len(marks) <= 60 and max(map(len, bags)) == 5


def test_quality_query(spark):
    got = queries.op2_quality(spark, str(DATA)).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    good, bad = ([r.keep for r in got if labels.get(r.doc_id) == q] for q in (1, 0))
    assert len(got) == 200 and np.mean(good) > 0.9 and np.mean(bad) < np.mean(good)


def test_quality_on_odd_rows(spark, odd):
    got = queries.op2_quality(spark, odd).collect()
    by = {r.doc_id: r for r in got if r.doc_id not in (None, 1, 7)}
    assert sum(r.doc_id == 1 for r in got) == 2 and by[2].perplexity is None and not by[2].keep and not by[3].keep and by[0].keep
    assert by[4].perplexity is None and by[4].keep  # no trusted text in its language


def test_token_and_pii_queries_on_odd_rows(spark, odd):
    got = {r.doc_id: r for r in queries.op4_token_counts(spark, odd).collect() if r.doc_id not in (None, 1, 7)}
    assert (got[2].n_bytes, got[2].n_tokens, got[3].n_tokens, got[2].over_limit) == (0, 0, 0, False)
    seven = [r for r in queries.op4_token_counts(spark, odd).collect() if r.doc_id == 7]
    assert sorted(r.over_limit for r in seven) == [False, True]
    got = {r.doc_id: r for r in queries.op5_pii(spark, odd).collect() if r.doc_id not in (None, 1, 7)}
    assert (got[50].n_email, got[50].n_card, got[50].n_ip, got[50].n_phone) == (1, 1, 0, 0) and got[50].spans == "email:5:12,card:17:36"
    assert got[50].base_sha256 == hashlib.sha256(b"email:5:12,card:17:36").hexdigest() and got[2].base_sha256 == hashlib.sha256(b"").hexdigest() and got[2].spans == ""
    both = spark.createDataFrame([("a@b.org", 1), (None, 2)], "text string, i int").select(pii.redaction()("text"), pii.spans()("text")).collect()
    assert both[0][0] == "[EMAIL]" and both[0][1][0].kind == "email" and both[1][0] is None and both[1][1] == []


def reachable(fps, ids):
    """Smallest id in each document's component, by breadth-first search over all pairs."""
    f = np.array(fps, np.uint64)
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    out = [None] * len(ids)
    seen = np.zeros(len(ids), bool)
    for i in order:
        if seen[i]:
            continue
        stack, seen[i] = [i], True
        while stack:
            j = stack.pop()
            out[j] = ids[i]
            near = np.flatnonzero((np.bitwise_count(f ^ f[j]) <= 4) & ~seen)
            seen[near] = True
            stack += near.tolist()
    return out


@pytest.mark.parametrize("ball", [simhash.BALL, 3])
@pytest.mark.parametrize("kind", ["random", "dense", "chain"])
def test_links_equal_brute_force(spark, kind, ball, monkeypatch):
    monkeypatch.setattr(simhash, "DENSE", ball)
    r = random.Random(kind)
    flip = lambda x, n: x ^ sum(1 << b for b in r.sample(range(64), n))
    if kind == "dense":
        centre = r.getrandbits(64)
        fps = [flip(centre, r.randint(0, 5)) for _ in range(700)] + [flip(centre, 12) for _ in range(60)]
    elif kind == "chain":
        fps = [r.getrandbits(64)]
        for _ in range(300):
            fps.append(flip(fps[-1], 4))
        fps += [flip(x, 5) for x in fps[:200]]
    else:
        base_ = [r.getrandbits(64) for _ in range(300)]
        fps = base_ + [flip(r.choice(base_), r.randint(0, 6)) for _ in range(900)]
    distinct = sorted(set(fps))
    signed = [x - 2**64 if x >= 2**63 else x for x in distinct]
    nodes = base.written(spark.createDataFrame([(x,) for x in signed], "fp bigint"))
    got = {a: b for a, b in simhash.links(nodes).collect()}
    expected = reachable(distinct, signed)
    assert [got[x] for x in signed] == expected


@pytest.mark.parametrize("dense", [simhash.DENSE, 100])
def test_a_hot_group_makes_few_rows(spark, dense, monkeypatch):
    """Thousands of near copies, of which most pairs are not linked: what joins make stays in proportion to the group."""
    monkeypatch.setattr(simhash, "DENSE", dense)
    made = []
    monkeypatch.setattr(simhash, "written", lambda df: (made.append(base.written(df)), made[-1])[1])
    r = random.Random(5)
    centre = r.getrandbits(64)
    distinct = sorted({centre ^ sum(1 << b for b in r.sample(range(64), r.randint(4, 9))) for _ in range(3000)})
    signed = [x - 2**64 if x >= 2**63 else x for x in distinct]
    nodes = base.written(spark.createDataFrame([(x,) for x in signed], "fp bigint"))
    got = {a: b for a, b in simhash.links(nodes).collect()}
    assert [got[x] for x in signed] == reachable(distinct, signed)
    assert max(df.count() for df in made) <= 65 * len(distinct)


def test_simhash_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    fps = simhash.fingerprints([d.text for d in docs]).tolist()
    expected = sorted((d.doc_id, f"{f:016x}", c) for d, f, c in zip(docs, fps, reachable(fps, [d.doc_id for d in docs])))
    assert sorted(tuple(r) for r in queries.op6_simhash(spark, str(DATA)).collect()) == expected


def test_simhash_on_odd_rows(spark, odd):
    got = queries.op6_simhash(spark, odd).collect()
    assert {r.component_id for r in got if r.doc_id in (2, 3)} == {2} and all(r.fingerprint == "0" * 16 for r in got if r.doc_id in (2, 3))
    assert {r.component_id for r in got if r.doc_id in (0, 1)} == {0}
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == ["2", "None"]


def test_components(spark):
    r = random.Random(3)
    pairs = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(260)] + [(1000, k) for k in range(500, 700)] + [(k, k + 1) for k in range(2000, 2100)] + [(5, 5)]
    got = dict(tuple(x) for x in simhash.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect())
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    assert got == {x: root(x) for x in up}


def check_pieces(spark, rows, docs):
    encode = packing.encoder(queries.vocabulary()).ids
    expected = sorted(zlib.crc32(encode(t or "") + b"\0\0\0\0") for t in docs)
    whole, fill = {}, {}
    for r in rows:
        assert 0 < r.length <= 1024
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
        whole.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
    for parts in fill.values():
        end = 0
        for at, length in sorted(parts):
            assert at == end
            end += length
        assert end <= 1024
    assert sum(r.length for r in rows) == sum(len(encode(t or "")) // 4 + 1 for t in docs)
    return whole, expected, 1 - sum(r.length for r in rows) / (1024 * len(fill))


def test_packing(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    rows = queries.op7_packing(spark, str(DATA)).collect()
    whole, _, padding = check_pieces(spark, rows, [d.text for d in docs])
    encode = packing.encoder(queries.vocabulary()).ids
    for d in docs:
        ids = encode(d.text) + b"\0\0\0\0"
        parts = sorted(whole[d.doc_id, len(ids) // 4])
        assert parts == [(a, min(1024, len(ids) // 4 - a), zlib.crc32(ids[4 * a : 4 * a + 4096])) for a in range(0, len(ids) // 4, 1024)]
    assert padding < 0.02


def test_packing_odd_rows(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet").collect()
    rows = queries.op7_packing(spark, odd).collect()
    check_pieces(spark, rows, [d.text for d in docs])
    assert sum(r.doc_id is None for r in rows) == 2 and [r.doc_tokens for r in rows if r.doc_id == 2] == [1]


def test_toxicity_query(spark, odd):
    got = queries.op8_toxicity(spark, odd).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got) and not any(r.held_out is None for r in got)
    for sf in ["/root/testdata/sf0.1"]:
        labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
        held = [r for r in queries.op8_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
        assert np.mean([r.predicted for r in held if labels[r.doc_id] == 1]) > 0.85 and np.mean([r.predicted for r in held if labels[r.doc_id] == 0]) < 0.01


def test_top_k_on_odd_rows(spark, odd):
    names, expected = duck(odd, queries.ORACLE_SQL["op9_exact_top_k"])
    got = [tuple(r) for r in queries.op9_exact_top_k(spark, odd).collect()]
    assert sorted(got) == sorted(expected) and len({r[0] for r in got}) > 3


def test_top_k_of_any_size(spark):
    """Components up to the limit of a float and of a double, against exact integers held within 64 bits."""
    r = random.Random(6)
    size = lambda: r.choice([1.0, 1e3, 3e7, 1e14, 3.4e38, 1.7e308]) * r.uniform(-1, 1)
    held = [(i * 10, [size() for _ in range(3)]) for i in range(60)]
    got = {}
    for row in topk.top_k(spark.createDataFrame(held, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 50 == 0, block=16).collect():
        got.setdefault(row.query_id, []).append((row.rank, row.vec_id, row.score))
    whole = lambda v: [int(x) * 256 if abs(x) > 2**60 else math.floor(x * 256) for x in v]
    for i, v in held:
        if i % 50 == 0:
            scores = [(-min(max(sum(a * b for a, b in zip(whole(v), whole(w))), topk.LEAST), topk.MOST), j) for j, w in held if j != i]
            assert sorted(got[i]) == [(k, j, -s) for k, (s, j) in enumerate(sorted(scores)[:5], 1)]
    assert len(got) == 12


def test_packing_a_hot_length(spark, monkeypatch):
    """One length holds most pieces; salts grow with it, and pieces try few slots each."""
    monkeypatch.setattr(packing, "SALT_ROWS", 50)
    lengths = [64] * 6000 + [random.Random(2).randint(1, 100) for _ in range(1500)]
    pieces = spark.createDataFrame(list(enumerate(lengths)), "id int, length int").withColumn("row", F.lit(1)).withColumn("salt", F.lit(2))
    out = packing.pack(pieces, ["id"], size=100)
    rows = out.collect()
    fill = {}
    for x in rows:
        fill.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in fill.values():
        assert [a for a, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 100
    assert sorted(x.id for x in rows) == list(range(7500)) and {*out.columns} == {"id", "length", "row", "salt", "sequence_id", "offset"}


def test_top_k_blocks_are_exact(spark):
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet")
    small = topk.top_k(vectors, F.col("vec_id") % 50 == 0, block=60, query_block=3).collect()
    assert sorted(map(tuple, small)) == sorted(map(tuple, topk.top_k(vectors, F.col("vec_id") % 50 == 0).collect()))


def test_decontamination_on_odd_rows(spark, odd):
    got = [tuple(r) for r in queries.op10_decontamination(spark, odd).collect()]
    assert sorted(got) == [(5, 1, 26, 26, 1.0), (6, 1, 26, 26, 1.0)]


def test_containment_equals_brute_force(spark):
    r = random.Random(8)
    items = [(i, words(100 + i, r.choice([5, 6, 9, 14, 30, 59]))) for i in range(30)]
    docs = []
    for k in range(120):
        held = items[r.randrange(30)][1].split()
        for _ in range(r.randint(0, 3)):
            held[r.randrange(len(held))] = "odd"
        docs.append((k, words(500 + k, r.randint(0, 300)) + " " + " ".join(held) + ". " + words(900 + k, r.randint(0, 300)), "en", "s", 0))
    cut = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().replace(".", " ").split()] for i in range(len(w) - 4)}
    expected = set()
    for d in docs:
        for i, t in items:
            own = cut(t)
            both = len(own & cut(d[1]))
            if both >= 0.8 * len(own):
                expected.add((d[0], i, len(own), both))
    got = decontam.contained(spark.createDataFrame(docs, SCHEMAS["documents"]), spark.createDataFrame(items, SCHEMAS["benchmark"]))
    assert {tuple(x)[:4] for x in got.collect()} == expected and len(expected) > 40


def test_decontamination_is_native(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string")
    plan = decontam.contained(docs, spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pipeline_stages(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "pii", "packing"]
    stage = {n: f(spark, docs, odd) for n, f in corpus_pipeline.STAGES}
    for n in names[:-1]:
        assert stage[n].columns == docs.columns
    ids = lambda df: sorted(str(r.doc_id) for r in df.collect())
    dedup = ids(stage["near_duplicates"])
    assert dedup == sorted(map(str, [0, 2, None, 4, 5, 6, 7, 7, 50, 51, 52, 53]))
    assert ids(stage["decontamination"]) == sorted(str(r.doc_id) for r in docs.collect() if r.doc_id not in (5, 6))
    redacted = {r.doc_id: r for r in stage["pii"].collect()}
    assert redacted[50].text == "mail [EMAIL] and [CARD] <|endoftext|>" and redacted[50].n_chars == len(redacted[50].text) and redacted[2].text is None
    assert stage["pii"].count() == docs.count() and set(stage["pii"].columns) >= {"TOKENS", "mark"}


def test_pipeline_equals_its_parts(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = docs.collect()
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scores = toxicity.scored(model, [d.text for d in held])
    kept = [d for d, s in zip(held, scores) if s < 0.5]
    kept.sort(key=lambda d: d.doc_id)
    kept = [d for k, (d, c) in enumerate(zip(kept, jaccard_groups([d.text for d in kept]))) if k == c]
    _, pairs = duck(sf, queries.ORACLE_SQL["op10_decontamination"])
    leaks = {p[0] for p in pairs}
    kept = [d for d in kept if d.doc_id not in leaks]
    texts = {d.doc_id: pii.redacted(d.text, pii.found(d.text)) for d in kept}
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(texts) and 0 < len(texts) < len(held)
    check_pieces(spark, rows, list(texts.values()))
