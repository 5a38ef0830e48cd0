"""What the first round's review found to be cut short, each against brute force."""

import io
import random
import re
from pathlib import Path

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from tracemill.llm import quality, simhash, toxicity, warc
from tracemill.llm.base import shared_dir


def copies(seed, roots, each, least, most):
    """Texts, of which some are others with a few words replaced."""
    r = random.Random(seed)
    stock = [f"w{i}" for i in range(3000)]
    line = " ".join(r.choice(stock) for _ in range(30))
    out = []
    for _ in range(roots):
        own = [r.choice(stock) for _ in range(r.randint(least, most))]
        for _ in range(each):
            made = list(own)
            for _ in range(r.randint(0, 6)):
                made[r.randrange(len(made))] = r.choice(stock)
            out.append(" ".join(made) + (f" {line}" if r.random() < 0.5 else ""))
    r.shuffle(out)
    return out


def jaccard_groups(texts, share=0.8, words=5):
    """Smallest number of each text's component, over all pairs."""
    cut = lambda w: {tuple(w[i : i + words]) for i in range(max(len(w) - words, 0) + 1)} if w else set()
    sets = [cut((t or "").lower().split()) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both >= share * len(sets[i] | sets[j]) - 1e-9:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [root(i) for i in range(len(texts))]


def test_near_copies_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SAMPLE", 100)
    texts = [*copies(1, 40, 6, 40, 300), *copies(2, 3, 40, 80, 90), None, "", "a b", "A  b", "a b c d e", "a b c d e f"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    got = dict(tuple(x) for x in simhash.near_copies(df).collect())
    expected = jaccard_groups(texts)
    assert [got[i] for i in range(len(texts))] == expected and 50 < len(set(expected)) < len(texts) - 100


def test_pipeline_drops_every_near_copy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = docs.collect()
    groups = jaccard_groups([d.text for d in sorted(held, key=lambda d: d.doc_id)])
    ids = sorted(d.doc_id for d in held)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "/root/testdata/sf0.01").collect()
    assert sorted(d.doc_id for d in kept) == sorted({ids[g] for g in groups})


@pytest.mark.parametrize("far", [False, True])
def test_near_copies_by_fingerprint(spark, monkeypatch, far):
    """Fingerprints' links are used, and nothing is lost or added where they tell nothing: where all are equal or none near."""
    texts = [*copies(1, 10, 6, 40, 300), *copies(2, 3, 10, 80, 90), None, "", "a b", "A  b", "a b c d e", "a b c d e f"]
    asked, plain = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda nodes: asked.append({r.fp for r in nodes.collect()}) or plain(nodes))
    if far:  # the sum of a set's hashes: another one for every set
        monkeypatch.setattr(simhash, "majorities", lambda held: np.array([h.sum() for h in held], np.uint64))
    else:
        monkeypatch.setattr(simhash, "majorities", lambda held: np.zeros(len(held), np.uint64))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = dict(tuple(x) for x in simhash.near_copies(df).collect())
    assert [got[i] for i in range(len(texts))] == jaccard_groups(texts)
    assert len(asked) == 1 and (len(asked[0]) > 40 if far else asked[0] == {0})


def test_fingerprints_link_before_the_search(spark, monkeypatch):
    """Long texts that differ in a word: their pair is decided by their fingerprints, so the search for others tries none."""
    base = [f"w{k}" for k in range(1500)]
    texts = [" ".join(base), " ".join([*base[:-1], "other"]), " ".join(["first", *base[1:]]), " ".join(f"x{k}" for k in range(50))]
    fps = simhash.majorities([simhash.shingle_set(t, 5, 42).view(np.uint64) for t in texts]).tolist()
    assert all(bin(fps[0] ^ f).count("1") <= 4 for f in fps[1:3])
    found, plain = [], simhash._by_fingerprint
    monkeypatch.setattr(simhash, "_by_fingerprint", lambda nodes: found.append(plain(nodes)) or found[-1])
    tried, write = [], simhash.written

    def counting(df):
        out = write(df)
        if found and out.columns == ["a", "b"]:
            tried.append(sorted((r.a, r.b) for r in out.collect()))
        return out

    monkeypatch.setattr(simhash, "written", counting)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3]
    assert tried[0] == tried[1] and len(tried[0]) == 2  # both pairs pass the exact check
    assert [] in tried  # and the search has none left to try


def test_quality_keeps_good_text_that_was_not_learned(spark):
    r = random.Random(4)
    stock = ["".join(r.choice("abcdefghijklmnopqrst") for _ in range(r.randint(2, 9))) for _ in range(1500)]
    docs = [(i, " ".join(r.choice(stock) for _ in range(60)), "en") for i in range(800)] + [(1000 + i, "".join(r.choice("0123456789#%&") for _ in range(300)), "en") for i in range(40)]
    documents = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(400)], "doc_id bigint, quality int")
    kept = {x.doc_id for x in quality.classified(documents, labels).collect() if x.keep}
    assert sum(i in kept for i in range(400, 800)) >= 380 and sum(i in kept for i in range(400)) >= 380 and not any(i in kept for i in range(1000, 1040))


@pytest.mark.parametrize("noisy", [False, True])
@pytest.mark.parametrize("payload", [False, True])
def test_warc_heads_of_any_length(noisy, payload):
    r = random.Random(1)
    url = "http://a/" + ("".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(70000)) if noisy else "x" * 70000)
    row = {"record_id": "<urn:x>", "record_type": "response", "target_uri": url, "warc_date": None, "payload_digest": None, "refers_to": None, "payload_bytes": 9000, "payload": b"p" * 9000}
    block = b"HTTP/1.1 200 OK\r\nX-Long: " + (r.randbytes(2500).hex().encode() if noisy else b"y" * 5000) + b"\r\nContent-Length: 9000\r\n\r\n" + b"p" * 9000
    long = f"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    reader = warc.WarcReader({"path": "/x", "payload": str(payload)})
    held = [warc.record(row), long, warc.record(row | {"target_uri": "u"})]
    for read, blob in ((warc._gzip_records, b"".join(map(warc.member, held))), (warc._plain_records, b"".join(held))):
        got = [reader._row(h, b) for h, b in read(warc.Stream(io.BytesIO(blob)), lambda h: (True, payload))]
        assert [x[2] for x in got] == [url, None, "u"] and [x[6] for x in got] == [9000] * 3
        assert [x[8] for x in got] == ([b"p" * 9000] * 3 if payload else [None] * 3)


def crowd(seed, groups, each, changed):
    """Texts of 100 words, of which `changed` are replaced in each copy."""
    r = random.Random(seed)
    out = []
    for g in range(groups):
        root = [f"g{g}w{r.randrange(10**6)}" for _ in range(100)]
        for c in range(each):
            made = list(root)
            for k in r.sample(range(100), changed):
                made[k] = f"own{g}x{c}x{k}"
            out.append(" ".join(made))
    return out


def pairs_tried(spark, monkeypatch, texts):
    """Components of the texts, and the candidate pairs that were compared."""
    tried, plain = [], simhash.written

    def counting(df):
        out = plain(df)
        if out.columns == ["a", "b"]:
            tried.append(out.count())
        return out

    monkeypatch.setattr(simhash, "written", counting)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    roots = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    monkeypatch.setattr(simhash, "written", plain)
    return [roots[k] for k in range(len(texts))], sum(tried)


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_a_crowd_that_is_alike_but_not_near_makes_no_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "COMMON", 10**9)  # no shingle is common from the start
    monkeypatch.setattr(simhash, "MOST_LATE", most)
    monkeypatch.setattr(simhash, "CROWD", 32)  # the library's bound is four times that, for groups as large in proportion
    tried = []
    for g in (150, 300):
        roots, n = pairs_tried(spark, monkeypatch, crowd(g, 1, g, 4))
        assert roots == list(range(g))
        tried.append(n)
    assert max(tried) <= 300  # all pairs would be 11,175 and 44,850


def test_a_crowd_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(simhash, "COMMON", 10**9)
    roots, n = pairs_tried(spark, monkeypatch, crowd(5, 1, 500, 4))
    assert roots == list(range(500)) and n <= 500  # all pairs would be 124,750


def test_crowds_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "COMMON", 10**9)
    monkeypatch.setattr(simhash, "CROWD", 8)
    texts = [*crowd(1, 3, 30, 1), *crowd(2, 3, 30, 2), *crowd(3, 2, 30, 4), None, "", "a b c"]
    roots, _ = pairs_tried(spark, monkeypatch, texts)
    assert roots == jaccard_groups(texts)


def damage(kind, tmp_path):
    """A folder with one file of three records, of which the last is damaged, and the byte at which that begins."""
    import gzip

    row = {"record_id": "<urn:x>", "record_type": "response", "target_uri": "u", "warc_date": None, "payload_digest": None, "refers_to": None, "payload_bytes": 5000, "payload": bytes(random.Random(1).randbytes(5000))}
    plain = [warc.record(row | {"record_id": f"<{k}>"}) for k in range(3)]
    held = {"own": [warc.member(x) for x in plain], "other": [gzip.compress(x) for x in plain]}.get(kind.split("-")[0], plain)
    how = kind.split("-")[1]
    last = {"body": held[2][:2085], "head": held[2][:60], "start": held[2][:11], "odd": b"\x00odd" + held[2]}[how]
    (tmp_path / ("a.warc" if held is plain else "a.warc.gz")).write_bytes(held[0] + held[1] + last)
    return str(tmp_path), len(held[0]) + len(held[1])


@pytest.mark.parametrize("payload", [True, False])
@pytest.mark.parametrize("kind", [f"{file}-{how}" for file in ("own", "other", "plain") for how in ("body", "head", "start", "odd")])
def test_damaged_archives(kind, payload, tmp_path):
    path, at = damage(kind, tmp_path)

    def found(**more):
        reader = warc.WarcReader({"path": path, "payload": str(payload), **more})
        return [r for b in reader.read(reader.partitions()[0]) for r in b.to_pylist()]

    with pytest.raises(warc.Damaged, match=rf"a\.warc.* at byte {at}\b"):
        found()
    assert [r["record_id"] for r in found(damaged="skip")] == ["<0>", "<1>"]


def test_blank_lines_are_no_record_and_damage_reaches_the_job(spark, tmp_path):
    row = {"record_id": "<a>", "record_type": "response", "target_uri": "u", "warc_date": None, "payload_digest": None, "refers_to": None, "payload_bytes": 2, "payload": b"ok"}
    (tmp_path / "a.warc").write_bytes(warc.record(row) + b"\r\n\n\r\n")
    assert warc.read_warc(spark, str(tmp_path)).count() == 1
    (tmp_path / "b.warc").write_bytes(warc.record(row)[:-40])
    assert warc.read_warc(spark, str(tmp_path), damaged="skip").count() == 1
    with pytest.raises(Exception, match="b.warc: the WARC record at byte 0 is damaged"):
        warc.read_warc(spark, str(tmp_path)).collect()


def test_items_that_share_a_passage_meet_few_documents(spark, monkeypatch):
    from tracemill.llm import decontam

    r = random.Random(6)
    passage = " ".join(f"p{r.randrange(10**6)}" for _ in range(60))
    own = [" ".join(f"i{k}x{j}" for j in range(30)) for k in range(40)]
    items = spark.createDataFrame([(k, f"{passage} {x}") for k, x in enumerate(own)], "item_id bigint, text string")
    docs = [(k, f"a b c {passage} d e {k}") for k in range(200)] + [(1000 + k, f"x {passage} {own[k]} y") for k in range(5)]
    found = []
    plain = decontam.written
    monkeypatch.setattr(decontam, "written", lambda df: found.append(out) or out if "text_key" in (out := plain(df)).columns and "item" in out.columns else out)
    got = decontam.contained(spark.createDataFrame(docs, "doc_id bigint, text string"), items).collect()
    assert sorted((x.doc_id, x.item_id) for x in got) == [(1000 + k, k) for k in range(5)]
    assert sum(x.count() for x in found) <= 5  # 8,200 pairs of a document and an item share the passage


def test_training_gives_the_drivers_memory_back(spark):
    """The driver's Python lives beside its JVM: a fit over some 30 MB of hashes once left more than that behind for good."""
    words = "transform(sequence(1, 400), k -> translate(cast(abs(xxhash64(id, k)) as string), '0123456789', 'abcdefghij'))"
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr(f"concat_ws(' ', {words})").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 9 == 0).cast("int").alias("toxic"))
    anonymous = lambda: int(re.search(r"\nAnonymous:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024
    toxicity.train(docs.limit(100), labels)  # what is loaded once
    before = anonymous()
    toxicity.train(docs, labels)
    assert anonymous() - before < 20


def test_quality_moves_texts_when_model_and_ngrams_are_gone(spark, monkeypatch):
    """When texts and answers are shuffled, which takes most of the disk, only the answers and the trusted ids are still there."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    folder = Path(shared_dir(spark).removeprefix("file://"))
    tables = lambda: {p.name for p in folder.glob("tracemill-*")}
    before, found, pack = tables(), [], quality.packed
    monkeypatch.setattr(quality, "packed", lambda df: (found.append(tables() - before), pack(df))[1])
    assert quality.classified(docs, labels).count() == docs.count()
    assert [len(x) for x in found] == [2]
