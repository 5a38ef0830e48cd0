"""Whole queries against plain loops over the libraries' results, on the smallest tables and on the odd ones."""

import hashlib
import math
import re
import zlib
from pathlib import Path

import pytest

from test_operators import odd, put, words  # noqa: F401
from tracemill.llm import langid, queries, toxicity

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def documents(spark, folder):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


@needs_data
@pytest.mark.parametrize("tables", ["small", "odd"])
def test_token_counts(spark, request, tables):
    from tokenizers import Tokenizer

    folder = DATA if tables == "small" else request.getfixturevalue("odd")
    library = Tokenizer.from_file(queries.vocabulary())
    expected = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in documents(spark, folder)]
    got = queries.op4_token_counts(spark, folder).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, expected))


def luhn(digits):
    return sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text) if right(m[0])] for k, (p, right) in kinds.items()}


@needs_data
@pytest.mark.parametrize("tables", ["small", "odd"])
def test_personal_data(spark, request, tables):
    folder = DATA if tables == "small" else request.getfixturevalue("odd")
    expected = []
    for i, t in documents(spark, folder):
        found = base_spans(t or "")
        said = ",".join(f"{k}:{a}:{b}" for k, spans in found.items() for a, b in spans)
        expected.append((i, *map(len, found.values()), hashlib.sha256(said.encode()).hexdigest()))
    got = queries.op5_pii(spark, folder).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, expected))


@needs_data
def test_language_query_is_the_fitted_model_row_by_row(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.train(docs, where=queries.F.crc32(docs.doc_id.cast("string").cast("binary")) % 4 != 2)
    got = {r.doc_id: r for r in queries.op1_language_id(spark, DATA).collect()}
    assert len(got) == docs.count()
    for i, text in documents(spark, DATA):
        found, share = langid.bag(text or "")
        logits = [float(sum(w * model.table[b, k] for b, w in zip(found, share))) + float(model.bias[k]) for k in range(len(model.languages))]
        e = [math.exp((x - max(logits)) / model.temperature) for x in logits]
        best = max(range(len(e)), key=e.__getitem__)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i].lang_pred == (model.languages[best] if len(found) else "und")
        assert abs(got[i].score - (e[best] / sum(e) if len(found) else 0.0)) < 1e-4


@needs_data
def test_toxicity_query_is_the_fitted_model_row_by_row(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels, where=queries.F.crc32(labels.doc_id.cast("string").cast("binary")) % 5 != 0)
    weights = dict(zip(model.features.tolist(), model.weights.tolist()))
    got = {r.doc_id: r for r in queries.op8_toxicity(spark, DATA).collect()}
    assert len(got) == docs.count()
    for i, text in documents(spark, DATA):
        logit = model.intercept + math.fsum(weights.get(h, 0.0) for h in toxicity.bag(text or "").tolist())
        score = 1 / (1 + math.exp(-max(-35.0, min(35.0, logit))))
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert abs(got[i].score - score) < 1e-4 and got[i].predicted == (got[i].score >= 0.5)
