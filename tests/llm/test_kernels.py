"""Single-machine parts of the operators against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tracemill.llm import base, langid, packing, pii, quality, simhash, tokens, topk, toxicity, warc
from tracemill.llm.queries import vocabulary

ODD = "ab 'sdt\n\t  é日本١२<|endoftext|> 🎉́xyzTHE  \r\x1c\x85​123 \n "


def texts(seed, n, alphabet=ODD, most=60):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, most))) + ("<|endoftext|>x" if k % 7 == 0 else "") for k in range(n)]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def test_token_counts_equal_the_library(tokenizer):
    count = tokens.counter(vocabulary()).tokens
    for x in [*texts(1, 2000), "a" * 5000, "the " * 3000, " " * 3000, "\n" * 999]:
        assert count(x) == len(tokenizer.encode(x, add_special_tokens=False).ids), x[:80]


def test_latin_cut_equals_the_pattern():
    latin = [chr(c) for c in range(0x250) if tokens._is_latin(chr(c))]
    assert len(latin) > 490 and not tokens._is_latin("\x1c") and not tokens._is_latin("×") and not tokens._is_latin("²")
    for x in [*texts(6, 3000, latin, 40), *texts(7, 3000, " '\n\t\rstred ll_é1-", 40)]:
        assert tokens._is_latin(x) and tokens._split_latin(x) == tokens._split_any(x), repr(x)


def test_words_forget_without_changing_results():
    held = tokens.Words(len, 3)
    assert [held[w] for w in "a bb ccc dddd a eeeee bb".split()] == [1, 2, 3, 4, 1, 5, 2]
    assert len(held) <= 3 and len(held.old) <= 3


def test_token_ids_equal_the_library(tokenizer):
    encode = packing.encoder(vocabulary()).ids
    for x in texts(2, 2000):
        assert np.frombuffer(encode(x), "<u4").tolist() == tokenizer.encode(x, add_special_tokens=False).ids


def test_latin_texts_are_encoded_whole(tokenizer):
    encoder = packing.Encoder(vocabulary())
    latin = [chr(c) for c in range(0x250) if tokens._is_latin(chr(c))]
    short = [*texts(3, 1000, latin, 80), *texts(4, 1000, " '\n\t\rstred ll_é1-", 80), "a" * 400 + " " * 400 + "b"]
    for x in short:
        assert np.frombuffer(encoder.ids(x), "<u4").tolist() == tokenizer.encode(x, add_special_tokens=False).ids, repr(x)
    assert not encoder.words and not encoder.words.old  # none of their pre-tokens went to the library one by one
    for k, x in enumerate(["a" * 401 + " b", " " * 401 + "b", "b c" + "\n" * 401, "日本 b"]):
        assert np.frombuffer(encoder.ids(x), "<u4").tolist() == tokenizer.encode(x, add_special_tokens=False).ids, repr(x)
        assert encoder.words
        encoder.words.clear()


@pytest.mark.parametrize("merges", [["bc", "ab", "ab c"], ["ab", "ab c", "bc"]])
def test_vocabularies_that_rank_alone_does_not_give(tmp_path, merges):
    """In the first, `a bc` makes a token that is no merge, so merging by rank alone would give another id for abc."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    pairs = [tuple(m.split(" ")) if " " in m else tuple(m) for m in merges]
    known = [*map(chr, tokens.byte_symbols()), *("".join(p) for p in pairs)]
    own = Tokenizer(models.BPE({t: k for k, t in enumerate(known)}, pairs))
    own.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    own.save(str(tmp_path / "own.json"))
    encoder = packing.Encoder(str(tmp_path / "own.json"))
    assert (encoder.whole is None) == (merges[0] == "bc")
    for x in texts(5, 300, "abc ", 12):
        x = x.removesuffix("<|endoftext|>x")
        assert np.frombuffer(encoder.ids(x), "<u4").tolist() == own.encode(x).ids, repr(x)


@pytest.mark.parametrize("seed", range(20))
def test_patterns_place_every_length_once(seed):
    r = random.Random(seed)
    size = r.choice([8, 64, 1024])
    histogram = Counter(r.randint(1, size) for _ in range(r.choice([1, 10, 3000])))
    if seed == 3:
        histogram = Counter({5: 1000})
    placed: Counter = Counter()
    packs = packing.patterns(histogram, size)
    for held, n in packs:
        assert sum(held) <= size and n > 0
        for x in held:
            placed[x] += n
    assert placed == histogram
    spans: dict = {}
    for length, low, high, sequence, at in packing.slots(histogram, size):
        for k in range(low, high + 1):
            assert (length, k) not in spans
            spans[length, k] = (sequence + k - low, at)
    assert len(spans) == sum(histogram.values())
    by_sequence: dict = {}
    for (length, _), (sequence, at) in spans.items():
        by_sequence.setdefault(sequence, []).append((at, length))
    for parts in by_sequence.values():
        end = 0
        for at, length in sorted(parts):
            assert at == end
            end += length
    assert sorted(by_sequence) == list(range(len(by_sequence)))


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(x):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    ok = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s)), "phone": lambda s: 9 <= len(digits(s)) <= 15}
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, x) if ok[k](m[0])]


def test_pii_base_spans_equal_plain_patterns():
    cards = ["4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4.5.6.7.8", "256.1.1.1", "a@b.c@d.e", "+1 (555) 010-9999", "x@a@b.c", "é@b.c", "a@@b.c", "00000000001.2.3.4"]
    for x in [*cards, *texts(3, 5000, "a1.2@b-+ 3()%_.@@..4 5é", 150)]:
        assert [s for s in pii.found(x) if s[0] in pii.KINDS] == plain_spans(x), x


def test_pii_own_spans_context_and_redaction():
    x = "Konto: DE89370400440532013000, not DE88370400440532013000; mail a@b.org"
    spans = pii.found(x)
    assert [x[a:b] for k, a, b in spans if k == "iban"] == ["DE89370400440532013000"]
    assert pii.redacted(x, spans) == "Konto: [IBAN], not DE88370400440532013000; mail [EMAIL]"
    assert pii.score(x, *spans[0]) == 1.0 and pii.score("call +1 555 010 9999", "phone", 5, 20) > pii.score("num: +1 555 010 9999", "phone", 5, 20)
    assert pii.listed(spans) == "email:64:71,iban:7:29" and pii.found("") == []
    pii.found("a" * 200000 + "@" + "1" * 200000 + "." + "a@" * 50000 + "+1" * 50000)  # in good time


def plain_fingerprint(x):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    held = [None, "", " \t", "a", "a b c d", "a b c d e", "É A\x85b", *texts(4, 600, "abÉdEF \x0b \x85", 90)]
    assert simhash.fingerprints(held).tolist() == [plain_fingerprint(x) for x in held]


def test_ring_chains_lose_no_pair():
    """Any two fingerprints at most 4 bits apart share a bucket and pass the chains' budgets."""
    r = random.Random(5)
    for _ in range(2000):
        apart = 0
        for _ in range(r.randint(0, 4)):
            apart |= 1 << r.randrange(64)
        ok = False
        for i, start in enumerate(simhash.STARTS):
            turned = ((apart << start) | (apart >> (64 - start))) & (2**64 - 1)
            widths = (simhash.WIDTHS * 2)[i : i + 5]
            if all((turned >> (64 - sum(widths[:n]))).bit_count() <= 4 * n // 5 for n in range(1, 6)):
                ok = True
        assert ok


@pytest.mark.parametrize("seed", range(40))
def test_threshold_algorithm(seed):
    r = random.Random(seed)
    n, d = r.randint(1, 300), r.randint(1, 6)
    big = 10**12 if seed % 5 == 0 else 5
    x = np.array([[r.randint(-big, big) for _ in range(d)] for _ in range(n)], dtype=np.float64)
    ids = np.array(r.sample(range(1000), n))
    query = x[0] if seed % 7 else np.zeros(d)
    if seed % 5 == 0:
        query = query // 10 ** r.choice([0, 3, 9])
    got = list(zip(*(v.tolist() for v in topk.Lists(ids, x).best(int(ids[0]), query, 5))))
    score = [sum(int(a) * int(b) for a, b in zip(v, query)) for v in x]
    score = [min(max(s, topk.LEAST), topk.MOST) for s in score]
    expected = sorted(((-s, int(i)) for s, i in zip(score, ids) if i != ids[0]))[:5]
    assert got == [(i, -s) for s, i in expected]


def test_word_hashes_tell_words_and_texts():
    a, doc = base.word_hashes(["Über den. den", "", "x1 uber ÜBER"])
    assert doc.tolist() == [0, 0, 0, 2, 2, 2] and a[1] == a[2] and a[0] == a[5] != a[4]
    long = ("wort " * 200000)[:-1]
    found = [len(base.word_hashes(held)[0]) for _, held in base.pieces([long, "a b"])]
    assert sum(found) == 200002


def plain_features(x):
    words = [w for w in re.findall(r"[^\W\d_]+", x.lower())]
    return len(set(words) | set(zip(words, words[1:])) | {(a, "*", b) for a, b in zip(words, words[2:])})


def test_toxicity_features_and_model():
    for x in ["", "a", "a b a b c", "one, two; three two"]:
        assert len(toxicity.bag(x)) == plain_features(x)
    r = random.Random(1)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(26) for j in range(10)]
    make = lambda bad: " ".join(r.choice(words) for _ in range(60)) + (" vile" if bad else "") + " " + " ".join(r.choice(words) for _ in range(9))
    rows = [(make(k % 4 == 0), int(k % 4 == 0)) for k in range(400)]
    model = toxicity.fit([toxicity.bag(x) for x, _ in rows], [y for _, y in rows])
    held = [(make(k % 2 == 0), k % 2 == 0) for k in range(200)]
    scores = toxicity.scored(model, [x for x, _ in held])
    assert np.mean((scores >= 0.5) == [y for _, y in held]) > 0.98 and len(model.features) < 2000
    assert toxicity.scored(model, [None, ""])[0] == toxicity.scored(model, [""])[0]
    long = make(True) * 6000
    assert abs(toxicity.scored(model, [long, "x"])[0] - toxicity.scored(model, ["x", long])[1]) < 1e-12
    assert toxicity.scored(toxicity.fit([], []), ["a"])[0] < 1e-6 and toxicity.scored(toxicity.fit([toxicity.bag("a")], [1]), ["a"])[0] > 0.99


def test_ftrl_steps_equal_the_definition():
    """Weights after the same rows in the same order, by one dictionary entry a coordinate."""
    r = random.Random(4)
    bags = [np.array(sorted(r.sample(range(12), r.randint(0, 6))), np.int32) for _ in range(60)]
    labels = np.array([float(3 in b or r.random() < 0.1) for b in bags])
    how = {"alpha": 0.7, "beta": 1.0, "l1": 0.3, "l2": 0.1, "epochs": 3}
    w, intercept = toxicity._descend(bags, labels, size=12, rng=np.random.default_rng(9), **how)
    z, n, rng = Counter(), Counter(), np.random.default_rng(9)

    def weight(f):
        rate = (how["beta"] + math.sqrt(n[f])) / how["alpha"]
        if f == "bias":
            return -z[f] / rate
        return 0.0 if abs(z[f]) <= how["l1"] else -(z[f] - math.copysign(how["l1"], z[f])) / (rate + how["l2"])

    for _ in range(how["epochs"]):
        for i in rng.permutation(len(bags)):
            held = {f: weight(f) for f in [*bags[i].tolist(), "bias"]}
            g = 1 / (1 + math.exp(-sum(held.values()))) - labels[i]
            for f, v in held.items():
                sigma = (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / how["alpha"]
                z[f] += g - sigma * v
                n[f] += g * g
    assert np.allclose(w, [weight(f) for f in range(12)]) and abs(intercept - weight("bias")) < 1e-9 and 0 < np.count_nonzero(w) < 12


def test_language_model():
    r = random.Random(2)
    stock = {"xx": ["lorem", "ipsum", "dolor"], "yy": ["strasse", "haus", "wald"], "zz": ["ñandu", "calle", "cosa"]}
    rows = [(" ".join(r.choice(w) for _ in range(r.randint(3, 40))), k) for k, w in stock.items() for _ in range(60)]
    r.shuffle(rows)
    model = langid.fit([(langid.bag(x), k) for x, k in rows])
    names, score, reliable = langid.predicted(model, ["HAUS 12 Wald!", None, "12 -", "ipsum" * 1, "wald " * 100000])
    assert names == ["yy", "und", "und", "xx", "yy"] and (score[[1, 2]] == 0).all() and reliable[0] and not reliable[1] and ((0 <= score) & (score <= 1)).all()
    one = langid.predicted(model, ["haus"])[1][0]
    assert abs(one - langid.predicted(model, ["calle", "haus", "x"])[1][1]) < 1e-6
    assert langid.predicted(langid.fit([]), ["a", None])[0] == ["und", "und"]


def plain_subwords(text):
    """Subwords of a text, as many times as they occur: 1 to 4 letters of a word between marks (0) at its ends."""
    out = Counter()
    for word in re.findall(r"[^\W\d_]+", text):
        marked = [0, *(ord(c.lower()[0]) for c in word), 0]
        for n in range(1, 5):
            for i in range(len(marked) - n + 1):
                own = marked[i : i + n]
                if own[0] or own[-1]:  # not both ends of a word at once
                    out[tuple(own)] += 1
    return out


def plain_bucket(subword):
    h = 0
    for c in subword:
        h = (h * 0x100000001B3 + c + 1) % 2**64
    return int(base.mixed(np.array([(h + (len(subword) << 40)) % 2**64], np.uint64))[0]) % langid.BUCKETS


def test_language_prediction_equals_brute_force():
    """The tabulated prediction is the softmax of the mean of the subwords' embeddings; equal logits go to the first name."""
    r = np.random.default_rng(3)
    embed, top = r.normal(size=(langid.BUCKETS, 4)), r.normal(size=(4, 3))
    model = langid.LanguageModel(["aa", "bb", "cc"], (embed @ top).astype(np.float32), r.normal(size=3), 0.7, 0.5)
    texts = ["Ein Haus", "a", "über 12 alles, ja", "x y z " * 50]
    names, score, _ = langid.predicted(model, texts)
    for text, name, got in zip(texts, names, score):
        found = plain_subwords(text)
        mean = sum(n * embed[plain_bucket(s)] for s, n in found.items()) / sum(found.values())
        e = np.exp((mean @ top + model.bias) / model.temperature)
        assert name == model.languages[int(e.argmax())] and abs(got - (e / e.sum()).max()) < 1e-4, text
    flat = langid.LanguageModel(["aa", "bb"], np.zeros((langid.BUCKETS, 2), np.float32), np.zeros(2), 1.0, 0.0)
    assert langid.predicted(flat, ["abc"])[0] == ["aa"]


def plain_kneser_ney(rows, order=5):
    """Interpolated modified Kneser-Ney over padded symbols, straight from its definition."""
    padded = lambda x: [quality.START] * (order - 1) + list(x.encode())
    levels = {order: Counter(tuple(s[i : i + order]) for x in rows for s in [padded(x)] for i in range(len(x.encode())))}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    discounts = {}
    for n, level in levels.items():
        c = Counter(level.values())
        y = c[1] / max(c[1] + 2 * c[2], 1)
        discounts[n] = [max(min(k - (k + 1) * y * c[k + 1] / c[k], k * 0.95), 0.05) if c[k] else k * 0.5 for k in (1, 2, 3)]

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / quality.SYMBOLS
        same = {h: v for h, v in levels[n].items() if h[:-1] == g[:-1]}
        if not same:
            return p(g[1:])
        d = lambda v: discounts[n][min(v, 3) - 1]
        total = sum(same.values())
        own = levels[n].get(g, 0)
        return ((own - d(own)) / total if own else 0) + sum(map(d, same.values())) / total * p(g[1:])

    return lambda x: sum(math.log(p(tuple(s[i : i + order]))) for s in [padded(x)] for i in range(len(x.encode())))


def quality_docs(spark, rows):
    """(lang, trusted, text) as the rows that the steps of the model take; the part is 1 for trusted texts, which thus count for part 0."""
    got = [(i, lang, int(good), good, text, i % 3) for i, (lang, good, text) in enumerate(rows)]
    return spark.createDataFrame(got, "doc_id bigint, lang string, part int, trusted boolean, text string, shard bigint")


def test_quality_model_equals_definition(spark):
    rows = ["the cat sat on the mat", "the hat that sat", "a cat and a hat", "über alles über", "x", "кот и кит", "猫坐在垫子上", "aaaaaaaaaaaaa"]
    asked = [*rows, "the dog", "zzz", "that cat über", "кит и кот", "猫猫", "", None, "\0\0\0\0\0\0"]
    docs = quality_docs(spark, [("en", True, x) for x in rows] + [("fr", True, "le chat")] + [("en", False, x) for x in asked] + [("xx", False, "q")])
    good = docs.where("trusted")
    number = quality.models(good)
    assert number == {("en", 0): 0, ("fr", 0): 1}
    scored = {r.doc_id: r for r in quality.perplexities(docs.where("not trusted"), quality.model(quality.counted(good, number)), number).collect()}
    plain = plain_kneser_ney(rows)
    assert len(scored) == len(asked) + 1
    for i, x in enumerate(asked, len(rows) + 1):
        assert scored[i].n == len(x or ""), x
        assert abs(scored[i].logp - plain(x)) < 1e-3 * len(x) if x else scored[i].logp is None, x
    assert scored[len(rows) + 1 + len(asked)].logp is None


def test_quality_thresholds_equal_definition(spark):
    r = random.Random(3)
    stock = {"en": ["the", "cat", "sat", "mat", "on", "a"], "ru": ["кот", "кит", "ток", "дом"], "zh": list("猫坐在垫子上")}
    rows = [(i, " ".join(r.choice(stock[lang]) for _ in range(r.randint(1, 9))), lang) for i, lang in enumerate(r.choices(["en", "ru", "zh"], k=60))]
    docs = spark.createDataFrame([*rows, rows[0], (None, "cat", None)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)] + [(None, 1), (99, 1)], "doc_id bigint, quality int")
    got = quality.classified(docs, labels, low=0.2, high=0.8).collect()
    part = {x.text: x.p for x in docs.select("text", F.pmod(F.xxhash64("text"), F.lit(2)).alias("p")).collect()}
    good = [x for x in [*rows, rows[0]] if x[0] % 3]
    held = {(lang, k): plain_kneser_ney([t for _, t, x in good if x == lang and part[t] != k]) for lang in stock for k in (0, 1)}
    perplexity = lambda x: math.exp(-held[x[2], part[x[1]]](x[1]) / len(x[1]))
    bounds = {lang: [sorted(perplexity(x) for x in good if x[2] == lang)[math.ceil(q * sum(x[2] == lang for x in good)) - 1] for q in (0.2, 0.8)] for lang in stock}
    assert sorted(x.doc_id for x in got if x.doc_id is not None) == sorted([*range(60), 0])
    for x in got:
        if x.doc_id is None:
            assert x.lang == "und" and x.perplexity is None and x.keep and x.n_chars == 3
            continue
        want, (low, high) = perplexity(rows[x.doc_id]), bounds[x.lang]
        assert abs(x.perplexity / want - 1) < 1e-3 and abs(x.low / low - 1) < 1e-3 and abs(x.high / high - 1) < 1e-3
        assert x.keep == (x.low <= x.perplexity <= x.high) and x.n_chars == len(rows[x.doc_id][1])


@pytest.mark.parametrize("window", [1 << 19, 7])
def test_quality_windows_of_any_length(window, monkeypatch):
    monkeypatch.setattr(quality, "WINDOW", window)
    texts = pa.array(["", "a", None, "ab", "кот" * 9, "long text " * 20, ""]).slice(1)
    data, ends = quality.spans(texts)
    got = np.concatenate([g for _, _, g in quality.windows(data, ends)])
    want = []
    for x in texts.to_pylist():
        s = bytes([quality.START] * (quality.ORDER - 1)) + (x or "").encode()
        want += [int.from_bytes(s[i : i + quality.ORDER], "big") for i in range(len(s) - quality.ORDER + 1)]
    assert got.tolist() == want


def test_hash_table():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 2**62, 5000).astype(np.uint64))
    values = r.normal(size=len(keys)).astype(np.float32)
    table = quality.Table(keys, values)
    found, got = table.get(keys)
    assert found.all() and (got == values).all() and not table.get(keys + np.uint64(1))[0].any()
    assert not quality.Table(keys[:0], values[:0]).get(keys)[0].any()


def test_warc_members():
    row = {"record_id": "<urn:x>", "record_type": "response", "target_uri": "http://a/\r\nX: y", "warc_date": None, "payload_digest": warc.base32_sha1(b"p" * 9000), "refers_to": None, "payload_bytes": 9000, "payload": b"p" * 9000}
    data = warc.record(row)
    import gzip
    import io

    assert gzip.decompress(warc.member(data)) == data and b"\r\nX: y" not in data
    blob = warc.member(data) + gzip.compress(data) + warc.member(warc.record(row | {"record_type": "revisit", "refers_to": "<urn:y>", "payload": None}))
    every = lambda h: (True, True)
    got = list(warc._gzip_records(warc.Stream(io.BytesIO(blob)), every))
    assert [len(b) for _, b in got][:2] == [len(got[0][1])] * 2 and got[0][1].endswith(b"p" * 9000) and got[2][0]["warc-type"] == "revisit"
    skipped = list(warc._gzip_records(warc.Stream(io.BytesIO(blob)), lambda h: (h["warc-type"] == "revisit", False)))
    assert len(skipped) == 1
    plain = list(warc._plain_records(warc.Stream(io.BytesIO(data * 3)), every))
    assert len(plain) == 3 and plain[2][1].endswith(b"p" * 9000)
    assert zlib.crc32(b"") == 0


@pytest.mark.parametrize("between", [" ", "\n", "\t", ",", " .\n", "4", ""])
def test_slices_change_nothing(monkeypatch, between):
    from tracemill.llm import base, langid, toxicity

    r = random.Random(7)
    words = ["".join(r.choice("abcdéßXYZ漢") for _ in range(r.randint(1, 9))) for _ in range(400)]
    texts = [between.join(words), between.join(words[:50]) + between, between * 300 + "end", None, "", "one", between.join(words[:20]) + " " + "long" * 100 + " a b"]
    whole = [(set(toxicity.bag(x or "").tolist()), langid.bag(x or "")) for x in texts]
    model = langid.LanguageModel(["a", "b"], np.random.default_rng(1).normal(0, 1, (langid.BUCKETS, 2)).astype(np.float32), np.zeros(2), 1.0, 0.0)
    scores = langid.predicted(model, texts)[1]
    weights = toxicity.ToxicityModel(np.unique(np.array(sorted(whole[0][0]), np.uint64)), np.random.default_rng(2).normal(0, 0.05, len(whole[0][0])).astype(np.float32), 0.1)
    toxic = toxicity.scored(weights, texts)
    monkeypatch.setattr(base, "SLICE", 64)
    assert len(list(base.pieces(texts[:1], 2))) > 10 or between == ""
    assert "".join(x for _, held in base.pieces(texts[:1]) for x in held) == texts[0]
    for x, (features, (found, share)) in zip(texts, whole):
        assert set(toxicity.bag(x or "").tolist()) == features
        again = langid.bag(x or "")
        assert again[0].tolist() == found.tolist() and np.allclose(again[1], share, rtol=1e-12)
    assert np.allclose(langid.predicted(model, texts)[1], scores, rtol=1e-6)
    assert np.allclose(toxicity.scored(weights, texts), toxic, rtol=1e-6)


def test_quality_answers_move_in_few_bytes(spark):
    r = random.Random(1)
    rows = sorted({(k % 3 - 1, r.randrange(1 << 44)) for k in range(60_000)})
    frame = spark.createDataFrame([(s, g, -(g % 50) / 7) for s, g in rows], "shard bigint, gram bigint, logp double")
    held = quality.bundled(frame.repartition(2)).collect()
    got = []
    for x in held:
        for b in pa.ipc.open_stream(x.rows):
            assert b.num_rows <= quality.BUNDLE
            got += [(x.shard, g, round(p * 7)) for g, p in zip(np.cumsum(b.column("step").to_numpy()).tolist(), b.column("logp").to_pylist())]
    assert sorted(got) == [(s, g, -(g % 50)) for s, g in rows]
    assert sum(len(x.rows) for x in held) < 10 * len(rows)  # a row each took 29 in the shuffle
