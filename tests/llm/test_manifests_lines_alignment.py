"""Line dedup and the Merkle manifest against DuckDB, token alignment against the two libraries, on odd tables."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from test_operators import SCHEMAS, odd, put, words  # noqa: F401
from tracemill.llm import alignment, linededup, merkle, queries

LINE = "This line, of forty code points or more, is in many texts"


@pytest.fixture(scope="module")
def many_lines(spark, tmp_path_factory):
    """Common lines with blanks and case changed, texts that repeat, null ids, long texts, keys just below and at the bounds."""
    r = random.Random(5)
    stock = [words(k, r.randint(5, 12)) for k in range(60)] + ["x" * 39, "y" * 40, " " * 50, "é" * 40, "É" * 40, " " + "z" * 40, "Z" * 40]
    docs = []
    for i in range(300):
        held = [r.choice(stock) for _ in range(r.randint(0, 9))]
        held = [r.choice([x, x.upper(), f" \t{x}\v\f\r", x + " "]) for x in held]
        docs.append((r.choice([i, i, i, i // 2, None]), "\n".join(held), r.choice(["en", "de", None, "ß", ""]), r.choice(["s", None]), r.choice([i, None])))
    docs += [(7, LINE, "en", "s", 1)] * 6 + [(None, LINE + " of nobody", "en", "s", 1)] * 6 + [(900, "\n" * 5000 + LINE, "x", "s", 2**63 - 1), (901, None, "x", None, None), (902, "", "y", "s", 0)]
    return put(spark, tmp_path_factory.mktemp("lines"), documents=(docs, {"mark": 1, "hash": 2, "tree": 3, "index": 4, "kept": 5, "path": 6, "shard": 7, "kind": 8}))


def by_duckdb(name, folder):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    found = c.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    return names, sorted(map(str, found.fetchall()))


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_merkle_manifest"])
@pytest.mark.parametrize("tables", ["odd", "many_lines"])
def test_equal_to_sql(spark, request, name, tables):
    folder = request.getfixturevalue(tables)
    names, expected = by_duckdb(name, folder)
    got = queries.QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(names)
    assert sorted(str(tuple(r)) for r in got.select(names).collect()) == expected


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_merkle_manifest", "op13_token_alignment"])
def test_empty_table(spark, tmp_path, name):
    assert queries.QUERIES[name](spark, put(spark, tmp_path)).count() == 0


def test_runs_tell_new_keys_and_are_compacted(spark):
    r = random.Random(1)
    store, seen, n = linededup.Runs(spark, every=2), {}, Counter()
    for k in range(7):
        batch = [(r.randrange(60), 100 - k) for _ in range(40)]
        rows = spark.createDataFrame([(x.to_bytes(16, "big"), d) for x, d in batch], "hash binary, doc_id bigint")
        new = {int.from_bytes(x.hash, "big") for x in store.new(rows.select("hash").distinct()).collect()}
        assert new == {x for x, _ in batch} - set(seen)
        store.add(rows)
        for x, d in batch:
            seen.setdefault(x, d)
            n[x] += 1
        assert all(len(level) < 2 for level in store.levels)
    assert len(store.levels) == 3
    assert {int.from_bytes(x.hash, "big"): (x.n, x.last) for x in store.totals().collect()} == {x: (n[x], seen[x]) for x in n}
    assert store.totals().count() == len(n)
    store.close()
    assert store.runs() == []


def test_a_batch_moves_and_runs_stay(spark):
    store = linededup.Runs(spark, every=9)
    rows = spark.range(1000).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("hash"), F.col("id").alias("doc_id"))
    store.add(rows)
    store.add(rows)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = store.new(rows.groupBy("hash").agg(F.count("*").alias("n")))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange hashpartitioning") == 1
    store.close()


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_manifest_of_any_fanout(spark, fanout):
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    docs = [(i, f"t{i}", "en" if i % 3 else None, "s", i) for i in range(60)] + [(1, "one", "fr", "s", 3)]
    f = lambda v: "-" if v is None else f"{len(str(v))}:{v}"
    trees = defaultdict(list)
    for i, t, lang, s, n in sorted(docs, key=lambda d: (d[2] is not None, d[2] or "", d[0])):
        trees[lang].append(h(f(i) + f(s) + f(lang) + f(n) + f(t)))

    def top(nodes):
        while len(nodes) > 1:
            nodes = [h("".join(nodes[k : k + fanout])) for k in range(0, len(nodes), fanout)]
        return nodes[0]

    found = merkle.audited(spark.createDataFrame(docs, SCHEMAS["documents"]), fanout).collect()
    assert {r.root for r in found} == {top([top(v) for v in trees.values()])}
    assert {r.leaf for r in found} == {x for v in trees.values() for x in v}
    assert {r.subroot for r in found} == {top(v) for v in trees.values()}
    import zlib

    assert {r.doc_id for r in found if not r.verified} == {i for i, *_ in docs if zlib.crc32(str(i).encode()) % 7 == 0}


def test_indices_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 50)
    rows = base_rows = [(t, r) for t in ("", "=a") for r in (random.Random(3).randrange(40) for _ in range(500))]
    made = merkle.numbered(spark.createDataFrame(rows, "tree string, key int").repartition(5), "tree", ["key"]).collect()
    for t in ("", "=a"):
        own = sorted((r["index"], r["key"]) for r in made if r["tree"] == t)
        assert [i for i, _ in own] == list(range(500)) and [k for _, k in own] == sorted(k for x, k in base_rows if x == t)
        assert {r["n"] for r in made if r["tree"] == t} == {500}


def by_libraries(docs):
    """doc_id and results by both libraries on whole texts, all links spelled out."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib, b_lib = Tokenizer.from_file(queries.vocabulary()), sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))
    a_lib.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}

    def piece(i):
        p = b_lib.id_to_piece(i)
        return bytes([int(p[1:-1], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode()

    out, count = [], defaultdict(set)
    for row, (key, text) in enumerate(docs):
        groups = []
        if text:
            whole = (" " + text).encode()
            a = a_lib.encode(" " + text, add_special_tokens=False)
            a = [(i, bytes(byte[c] for c in t)) for i, t in zip(a.ids, a.tokens)]
            b = [(i, piece(i)) for i in b_lib.encode(text)]
            if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b):
                ends = []
                for side in (a, b):
                    at, e = 0, []
                    for _, x in side:
                        at += len(x)
                        e.append(at)
                    ends.append(e)
                i = j = 0
                for cut in sorted(set(ends[0]) & set(ends[1])):
                    u, v = ends[0].index(cut, i) + 1, ends[1].index(cut, j) + 1
                    groups.append(([x for x, _ in a[i:u]], [x for x, _ in b[j:v]]))
                    i, j = u, v
        out.append((key, groups))
        for ga, gb in groups:
            for x in ga:
                for y in gb:
                    count[x, y].add(row)
    best = defaultdict(int)
    for (x, _), rows in count.items():
        best[x] = max(best[x], len(rows))
    done = []
    for key, groups in out:
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        said = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        done.append((key, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(len(count[p]) == best[p[0]] for p in links), sum(len(count[p]) for p in links), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return sorted(map(str, done))


NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_query_equals_libraries(spark, odd):  # noqa: F811
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{odd}/documents.parquet").collect()]
    got = queries.op13_token_alignment(spark, odd).select(*NAMES)
    assert sorted(str(tuple(r)) for r in got.collect()) == by_libraries(docs)


def test_alignment_of_odd_characters(spark, monkeypatch):
    for name, value in {"SHARD": 3000, "REMEMBERED": 50, "MOST_GROUPS": 300, "LONG": 200}.items():
        monkeypatch.setattr(alignment, name, value)
    r = random.Random(9)
    parts = ["a", "Hello", "don't", " ", "  ", "\n", "\t", " ", " ", "\u0085", "\x1c", "\x00", "\x7f", "é", "é", "漢字", "👍🏽", "123", "45.6", "...", "<|endoftext|>", "<s>", "<0x41>", "tokenization", "ﬁ", "x" * 300, "!!", "\r\n", "'s", "ß", "​", "�"]
    docs = [(i, "".join(r.choice(parts) for _ in range(r.randint(1, 30)))) for i in range(400)]
    docs += [(1000 + i, " ".join(r.choice(parts) for _ in range(r.randint(1, 30)))) for i in range(200)]
    docs += [(2000, " "), (2001, "  "), (2002, "a "), (2003, " a"), (2004, "▁a b"), (2005, "\n"), (2006, "a\n  b"), (2007, "a \n b "), (None, "a b"), (None, None), (2008, ""), (2009, "ab" * 20000), (2010, "q ▁")]
    got = alignment.aligned(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), queries.vocabulary(), queries.vocabulary("piece_bpe_32k.model"))
    assert sorted(str(tuple(x)) for x in got.select(*NAMES).collect()) == by_libraries(docs)


def test_both_ways_to_tokens_of_a_agree():
    made = alignment.aligner(queries.vocabulary(), queries.vocabulary("piece_bpe_32k.model"))
    r = random.Random(2)
    letters = "abcdefghij XYZ'0123456789.,!?éß漢👍\n\t-_"
    for k in range(3000):
        data = " " + "".join(r.choice(letters if k % 2 else "etaoinshr") for _ in range(r.randint(1, 60)))
        long = [t.id for w in alignment.pre_tokens(data) for t in made.model.tokenize(w.encode().decode("latin-1").translate(made.stand_in))]
        assert made.a.encode_ordinary(data) == long
