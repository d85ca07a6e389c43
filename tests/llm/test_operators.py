"""The training-data operators against brute force, and on odd tables."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from granary.llm import langid, licenses, packing, passages, quality, queries, sentencepieces, simhash, sketches, toxicity, urls

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept string, run string, part string, fp string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return sorted((r["doc_id"], r["text"]) for r in docs.collect())


@pytest.fixture(scope="module", params=["odd", "empty"])
def tables(spark, tmp_path_factory, request):
    path, long = str(tmp_path_factory.mktemp(request.param)), "word many words here " * 3000
    texts = [None, "", " \n", "one", "x" * 30_000, long, long, "日本語のテキスト 🎉", "a b c d e f g h", "a b c d e f g h", "Released under the MIT License."]
    data = [(i, t, "en" if i % 2 else None, None, None, "k", "r", "p", "f") for i, t in enumerate(texts)] + [(3, "one", "en", "s", 3, "k", "r", "p", "f"), (None, "no id", None, None, None, None, None, None, None)]
    odd = request.param == "odd"
    spark.createDataFrame(data if odd else [], COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 0), (None, None, None)] if odd else [], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    pages = [(1, "http://A.net/x"), (2, None), (3, "nothing"), (4, "https://x.org/fr/1"), (5, "http://h"), (5, "http://h"), (None, "s://e.com/a?b#c")]
    spark.createDataFrame([(*p, "h", "s") for p in pages] if odd else [], "page_id long, url string, host string, score string").write.parquet(f"{path}/pages.parquet")
    return path, len(data) if odd else 0, len(pages) if odd else 0


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_odd_tables(spark, tables, name):
    path, n_docs, n_pages = tables
    out = queries.queries()[name](spark, path).collect()
    if name == "op11_filter_audit":
        assert len(out) == (1200 if n_docs else 0)  # two parts
    elif name in queries.SQL:
        assert len(out) == (n_pages if name == "url_rules" else n_docs)
    elif name == "op8_packing":
        assert len({(r["doc_id"], r["piece"]) for r in out}) >= max(n_docs - 2, 0)
    else:
        assert len(out) == (n_pages if name == "op6_urls" else n_docs)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    from tests.oracle_check import compare

    assert compare(spark, SF, name, queries.queries()[name], queries.SQL[name]) == ""


def test_pipeline_on_odd_tables(spark, tables):
    """None of the odd texts has enough words that differ, so the quality rules leave nothing to pack."""
    assert corpus_pipeline.run(spark, tables[0]).collect() == []


def test_pipeline(spark, docs, rows):
    """The trained models' verdicts come from the operators' own queries; all else is computed plainly."""
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    good = [r["doc_id"] for r in quality.judge(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("kept").collect()]
    docs = docs.where(docs["doc_id"].isin(good))
    known = {r["doc_id"] for r in langid.predict(docs, langid.train(docs)).where("not rejected").collect()}
    assert 0 < len(known) <= len(good) < len(rows)
    left = [(i, t) for i, t in rows if i in known]
    low = plain_components({i: plain_wide(t) for i, t in left}, simhash.wide_radius())
    left = [(i, t) for i, t in left if low[i] == i]
    assert len(left) < len(known)
    want, some_gone = {}, False
    for doc_id, b, gone in plain_cut(left):
        some_gone |= bool(gone)
        text = bytes(c for k, c in enumerate(b) if k not in gone).decode("utf-8", "ignore")
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        want |= {(doc_id, n): (start, zlib.crc32(np.array(ids[start : start + 2048], "<u4").tobytes())) for n, start in enumerate(range(0, len(ids), 2048))}
    assert some_gone
    out = corpus_pipeline.run(spark, SF).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["ids_crc32"]) for r in out} == want and len(out) == len(want)
    ends: dict = {}
    for r in sorted(out, key=lambda r: r["offset"]):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 2048


def test_stages_return_documents(spark, docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).dtypes == docs.dtypes


def test_sentencepieces(docs, rows):
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    codec = sentencepieces.PieceCodec(sentencepieces.read_model(path))
    hard = ["", " ", "  a  b ", "\n\n x", "▁▁▁", "éß日本𝒳", "\x00", " " * 37 + "x", "1234 56", "aaaaaaaaaaaaaaaa"]
    for text in [*hard, *(t for _, t in rows[:60])]:
        ids = library.encode(text)
        assert codec.encode(text).tolist() == ids
        assert codec.decode(np.array(ids, np.int64)).decode() == library.decode(ids)


def plain_counters(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often: dict = {}
    for w in windows:
        often[w] = often.get(w, 0) + 1
    marked = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = (text or "").split("\n")
    dup = sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(marked)


def test_quality(spark, docs):
    """All counters and the verdict against plain ones, on whole texts."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    many = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    texts = {r["doc_id"]: r["text"] for r in many.collect()}
    out = {r["doc_id"]: r for r in quality.judge(many, labels).collect()}
    assert len(out) == len(texts)
    for doc_id, r in out.items():
        want = plain_counters(texts[doc_id])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["kept"] and r["base_failed"])
    good = {r["doc_id"]: r["quality"] for r in labels.where("quality is not null").collect()}
    passed = [r for i, r in out.items() if not r["base_failed"] and i in good]
    for stratum in ("en", "de", "fr"):  # a cutoff each, that loses few good documents and finds bad ones
        lost = [not r["kept"] for r in passed if r["stratum"] == stratum and good[r["doc_id"]]]
        found = [not r["kept"] for r in passed if r["stratum"] == stratum and not good[r["doc_id"]]]
        assert any(found) and np.mean(lost) <= quality.ALPHA, stratum
    kept = {r["doc_id"] for r in quality.keep_good(many.withColumn("n_words", many["doc_id"]), labels).select("doc_id").collect()}
    assert kept == {i for i, r in out.items() if r["kept"]}


def test_quality_cutoffs():
    from fractions import Fraction
    from math import comb

    for k, n, p in ((0, 10, 0.1), (1, 10, 0.1), (7, 400, 0.05)):
        exact = sum(comb(n, i) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i) for i in range(k + 1))
        assert quality.binomial_tail(k, n, p) == pytest.approx(float(exact))
    row = lambda half, good, x, n: {"stratum": "en", "proposes": half, "good": good, "evidence": x, "count": n}
    counts = [row(h, g, x, n) for h in (True, False) for g, x, n in ((True, 0.0, 1000), (True, 1.0, 1), (False, 0.0, 10), (False, 2.0, 50))]
    assert quality.certify(counts) == {"en": 2.0}
    assert quality.certify([c | {"count": -(-c["count"] // 50)} for c in counts]) == {}
    # good documents of the held-out half beyond the cutoff: not certified
    assert quality.certify([*counts, row(False, True, 3.0, 60)]) == {}


def test_langid(spark):
    out = queries.op3_langid(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.97
    assert not any(r["rejected"] for r in out)
    model = langid.CharModel(["abab", "abba", "baab"])
    points, starts = langid._points(["ab"])
    places = np.array([langid.ORDER - 1])
    total = sum(np.exp(model.log_probabilities(np.concatenate((points[: langid.ORDER - 1], [c])).astype(np.uint64), places))[0] for c in (97, 98, langid._BOUND))
    assert 0.5 < total <= 1.0


def test_langid_model_is_plain_kneser_ney():
    """Against a version with dictionaries of strings."""
    from collections import Counter

    rng = np.random.default_rng(12)
    words = ["".join(rng.choice(list("abcdé"), rng.integers(1, 7))) for _ in range(300)]
    order, bound = langid.ORDER, "#"
    padded = [bound * (order - 1) + w + bound for w in words]
    counts = Counter(p[i - order + 1 : i + 1] for p in padded for i in range(order - 1, len(p)))
    levels = []
    for n in range(order, 0, -1):
        values = list(counts.values())
        ones, twos = values.count(1), values.count(2)
        levels.insert(0, (counts, ones / (ones + 2 * twos) if ones and twos else 0.5))
        counts = Counter(g[1:] for g in counts)  # in how many longer ones
    letters = len(set("".join(padded))) + 1

    def probability(gram):
        if not gram:
            return 1 / letters
        counts, discount = levels[len(gram) - 1]
        after = [c for g, c in counts.items() if g[:-1] == gram[:-1]]
        lower = probability(gram[1:])
        return max(counts[gram] - discount, 0) / sum(after) + discount * len(after) / sum(after) * lower if after else lower

    model = langid.CharModel(words)
    for word in [*words[:10], "dbé", "zz", "aazb"]:
        points, starts = langid._points([word])
        got = model.log_probabilities(points, np.arange(order - 1, len(points)))
        text = bound * (order - 1) + word + bound
        want = [np.log(probability(text[i - order + 1 : i + 1])) for i in range(order - 1, len(text))]
        assert got == pytest.approx(want)


def test_langid_limits_reject_as_few_as_they_say():
    rng = np.random.default_rng(13)
    sizes = rng.integers(50, 5000, 3000).astype(float)
    truth = rng.integers(0, 2, 3000)
    entropies = 1.5 + truth + rng.normal(0, 1, 3000) * np.sqrt(0.0009 + (1.0 + truth) / sizes)
    limits = langid.calibrate(["a", "b"], entropies[:1000], truth[:1000], sizes[:1000])
    beyond = [e > limits["ab"[t]][0] + limits["ab"[t]][3] * np.sqrt(limits["ab"[t]][1] + limits["ab"[t]][2] / n) for e, t, n in zip(entropies[1000:], truth[1000:], sizes[1000:], strict=True)]
    assert np.mean(beyond) <= 0.002
    assert all(3 < limits[k][3] < 8 for k in "ab")


def test_langid_letters_and_small_tables(spark):
    assert [langid.words_of(t) for t in ("a² ½b Ⅷ 3 _", "²", None, "Éß日本 ñ", "x\U00010107y𝒳 🎉")] == [["a", "b"], [], [], ["éß日本", "ñ"], ["x", "y𝒳"]]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = ["Быстрая коричневая лиса прыгает через ленивую собаку и бежит домой", "²", "½ Ⅷ 12"]
    both = docs.union(spark.createDataFrame([(10**6 + i, t, None) for i, t in enumerate(odd)], docs.schema))
    model = langid.train(both)
    assert all(a > 0 and deviations > 0 for _, a, _, deviations in model["limits"].values()) and len(model["limits"]) == 4
    out = {r["doc_id"]: r for r in langid.predict(both, model).collect()}
    assert out[10**6]["rejected"] and [(out[10**6 + i]["lang_pred"], out[10**6 + i]["score"]) for i in (1, 2)] == [("und", 0.0)] * 2
    assert sum(r["rejected"] for i, r in out.items() if i < 10**6) == 0


def test_langid_without_languages(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, None, None), (3, "more", "")], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert {(r["lang_pred"], r["score"], r["rejected"]) for r in langid.predict(docs, model).collect()} == {("und", 0.0, True)}
    assert langid.keep_known(docs, model).count() == 0


def test_sketches(spark, docs, rows):
    def shingles(text):
        words = WORD.findall(text.lower())
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else ({tuple(words)} if words else set())

    def likeness(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    got = {r["doc_id"]: r for r in sketches.compare_edited(docs).collect()}
    for i, (doc_id, text) in enumerate(rows):
        follower = rows[i - 1][1]
        m = len(text) // 3
        edited, r = text[: len(text) - m] + follower[:m], got[doc_id]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r["near_edited"] - likeness(shingles(text), shingles(edited))) < 0.15
        assert abs(r["near_next"] - likeness(shingles(text), shingles(follower))) < 0.1


def test_toxicity():
    rng = np.random.default_rng(1)
    words = np.array([toxicity.buckets(w) for w in [f"w{i}" for i in range(200)] + ["vile"]])
    texts = [rng.integers(0, 200, 60) for _ in range(300)]
    labels = np.arange(300) % 2
    for t, y in zip(texts, labels, strict=True):
        if y:
            t[rng.integers(0, 60)] = 200
    net = toxicity.fit_network(texts[:200], words, labels[:200])
    tables = net.tables(words)
    logits = np.array([net.logit(t, tables) for t in texts[200:]])
    ahead = logits[labels[200:] == 1][:, None] > logits[labels[200:] == 0][None, :]
    assert ahead.mean() > 0.9


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    out = queries.op5_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r for r in out if r["toxic"]], [r for r in out if not r["toxic"]]
    ahead = np.array([r["score"] for r in toxic])[:, None] > np.array([r["score"] for r in clean])[None, :]
    assert ahead.mean() > 0.9 and np.mean([r["predicted"] for r in toxic]) > 0.7 and np.mean([r["predicted"] for r in clean]) < 0.02


def test_urls(spark):
    data = [(1, "https://a.b.net/x"), (2, "http://example.net/en/1"), (3, "http://EXAMPLE.com/de/x?y"), (4, "ftp://q.org/fr/"), (5, "http://net"), (6, "http://xnet/")]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(data, "page_id long, url string"), queries.URL_RULES).collect()}
    assert [got[i]["rule"] for i in range(1, 7)] == ["net/", "example.net/en/", "example.com/de/", "org/fr/", None, None]
    assert [got[i]["verdict"] for i in range(1, 5)] == ["block", "allow", "block", "allow"]
    x = np.array([[0.0, 1], [1, 0], [2, 1], [3, 0]] * 20)
    base, trees = urls.fit_trees(x, (x[:, 0] > 1).astype(float))
    value = lambda t, row: t if isinstance(t, float) else value(t[2] if row[t[0]] <= t[1] else t[3], row)
    assert all((base + sum(value(t, row) for t in trees) > 0) == (row[0] > 1) for row in x)


def plain_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    parts = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, min(len(words), 1)))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_wide(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    hashes = {xxhash.xxh64_intdigest(" ".join(words[i : i + 5]), 42) for i in range(max(len(words) - 4, min(len(words), 1)))}
    mix, full = 0x9E3779B97F4A7C15, (1 << 64) - 1
    out = 0
    for k in range(4):
        some = []
        for h in hashes:
            if k:
                h = (h ^ k) * mix & full
                h = (h ^ h >> 29) * mix & full
                h ^= h >> 32
            some.append(h)
        out |= sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in some) > len(some)) << 64 * k
    return out


def plain_components(fps, radius=4):
    low, changed = {i: i for i in fps}, True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= radius and low[b] < low[a]:
                    low[a], changed = low[b], True
    return low


def plain_cut(rows):
    """doc_id, bytes, numbers of bytes that go, of each text in order of doc_id."""
    seen: set = set()
    for doc_id, text in rows:
        b = text.encode()
        windows = [b[k : k + 50] for k in range(len(b) - 49)]
        yield doc_id, b, {x for k, w in enumerate(windows) if w in seen for x in range(k, k + 50)}
        seen.update(windows)


def test_simhash(docs, rows):
    fps = {i: plain_fingerprint(t) for i, t in rows}
    low = plain_components(fps)
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.classes(docs).collect()}
    assert got == {i: (fps[i], low[i]) for i in fps}


def test_tiles():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 62, 700) & 0xFF
    fps = np.concatenate((fps, fps[:300] ^ (1 << 40), fps[200:400] | np.int64(-1 << 63)))  # the highest bit too
    pops = np.bitwise_count(fps.view(np.uint64)).astype(np.int64)
    order = np.argsort(pops, kind="stable")
    fps, pops = fps[order], pops[order]
    low = simhash.tile_links(fps, pops, np.zeros(len(fps), np.int64), 1)
    near = np.bitwise_count((fps[:, None] ^ fps[None, :]).view(np.uint64)) <= 1
    want = np.arange(len(fps))
    while True:
        new = np.where(near, want[None, :], len(fps)).min(axis=1)
        if (new == want).all():
            break
        want = new
    assert (low == want).all()


def test_keep_first(spark, docs, rows):
    """One row of each group stays: by row, not by id; nulls come last; texts without words are copies of one another."""
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in rng.integers(0, 5000, 400)]
    text, near = " ".join(words), " ".join([*words[:200], "other", *words[201:]])
    far = " ".join([*words[:100], *(f"v{i}" for i in range(300))])
    long = " ".join(f"x{i}" for i in range(60_000))
    data = [(None, text), (1, text), (3, text), (3, far), (5, near), (6, "one two"), (6, "one two"), (7, ""), (8, None), (9, " \n"), (10, long), (11, long + " end")]
    df = spark.createDataFrame([(i, t, n, "r") for n, (i, t) in enumerate(data)], "doc_id long, text string, w0 int, row string")
    out = simhash.keep_first(df)
    assert out.columns == df.columns
    got = sorted((r["doc_id"], r["text"]) for r in out.collect())
    assert got == [(1, text), (3, far), (6, "one two"), (7, ""), (10, long)]
    assert simhash.keep_first(df.where("doc_id is null")).count() == 1 and simhash.keep_first(df.limit(0)).count() == 0


def test_wide_fingerprints_find_near_copies(spark):
    """Texts that share 0.8 of their shingles are found nine times of ten, those that share half of them aren't."""
    rng = np.random.default_rng(10)
    base = [[f"w{i}" for i in rng.integers(0, 9000, 300)] for _ in range(150)]

    def edited(words, n):
        words = list(words)
        for k in np.linspace(5, 290, n).astype(int):
            words[k] = f"new{k}"
        return " ".join(words)

    # each changed word spoils five of about 296 shingles: 6 leave 0.82, 20 leave 0.5
    data = [(i, " ".join(w)) for i, w in enumerate(base)] + [(1000 + i, edited(w, 6)) for i, w in enumerate(base)] + [(2000 + i, edited(w, 20)) for i, w in enumerate(base)]
    kept = {r["doc_id"] for r in simhash.keep_first(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert len([i for i in kept if i < 1000]) == 150
    assert len([i for i in kept if 1000 <= i < 2000]) <= 15
    assert len([i for i in kept if i >= 2000]) >= 145


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    out = packing.pack_documents(docs, path).collect()
    by_doc: dict = {}
    for r in sorted(out, key=lambda r: (r["doc_id"], r["piece"])):
        by_doc.setdefault(r["doc_id"], []).append(r)
    for doc_id, text in rows:
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        parts = [ids[i : i + 2048] for i in range(0, len(ids), 2048)]
        got = by_doc[doc_id]
        assert [r["length"] for r in got] == list(map(len, parts)) and [r["start"] for r in got] == [2048 * i for i in range(len(parts))]
        assert [r["ids_crc32"] for r in got] == [zlib.crc32(np.array(p, "<u4").tobytes()) for p in parts]
    places: dict = {}
    for r in sorted(out, key=lambda r: r["offset"]):
        assert r["offset"] == places.get(r["sequence_id"], 0)
        places[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(places.values()) <= 2048 and len(places) <= 1.02 * -(-sum(places.values()) // 2048) + 1


def test_passages(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(passages, "RUN_DOCS", 200)
    many = docs.repartition(5)  # several runs
    got = {r["doc_id"]: r for r in passages.cut_passages(many, digest=True).collect()}
    for doc_id, b, gone in plain_cut(rows):
        kept = bytes(c for k, c in enumerate(b) if k not in gone)
        spans = sum(k - 1 not in gone for k in gone)
        assert tuple(got[doc_id])[1:] == (len(b), len(gone), spans, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("hot", [0, 3, 5_000])
def test_passages_in_every_document(spark, monkeypatch, hot):
    """Nulls, repeated ids, runs of one byte, several runs, a passage in every document, with and without hot anchors."""
    monkeypatch.setattr(passages, "RUN_DOCS", 20)
    monkeypatch.setattr(passages, "HOT", hot)
    rng = np.random.default_rng(11)
    word = lambda: "".join(map(chr, rng.integers(97, 105, rng.integers(1, 7))))
    passage = " ".join(word() for _ in range(40)) + "é日"
    texts = [" ".join(word() for _ in range(int(n))) + passage + " ".join(word() for _ in range(int(n))) for n in rng.integers(0, 60, 90)]
    texts += [None, "", "a" * 49, "a" * 50, "a" * 300, "ab" * 100, passage[:60], passage[5:70], texts[3], texts[3], texts[4][:200] + "z" + texts[5]]
    data = [(int(i) if i % 17 else None, t) for i, t in enumerate(texts)] + [(5, texts[5]), (5, texts[6]), (7, None)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(6)
    last = np.iinfo(np.int64).max
    owners: dict = {}
    for i, t in data:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            owners[b[k : k + 50]] = min(owners.get(b[k : k + 50], last), last if i is None else i)
    want = []
    for i, t in data:
        b = (t or "").encode()
        gone = {x for k in range(len(b) - 49) if owners[b[k : k + 50]] < (last if i is None else i) for x in range(k, k + 50)}
        kept = bytes(c for k, c in enumerate(b) if k not in gone)
        want.append((str(i), len(b), len(gone), sum(k - 1 not in gone for k in gone), hashlib.sha256(kept).hexdigest()))
    tables = {t.name for t in spark.catalog.listTables()}
    got = [(str(r[0]), *r[1:]) for r in map(tuple, passages.cut_passages(df, digest=True).collect())]
    assert sorted(got) == sorted(want)
    assert {t.name for t in spark.catalog.listTables()} == tables


def test_anchors_need_little_memory(monkeypatch):
    """A run of 3 MB needs less than 35 times its bytes at once; hashes don't depend on how many places are taken together."""
    import tracemalloc

    rng = np.random.default_rng(8)
    table = pa.table({"doc_id": list(range(1000)), "text": [" ".join(f"w{i}" for i in rng.integers(0, 3000, 520)) for _ in range(1000)]})
    tracemalloc.start()
    run = passages.Run(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 35 * len(run.bytes)
    monkeypatch.setattr(passages, "PLACES_AT_ONCE", 1000)
    again = passages.Run(table)
    assert all(np.array_equal(getattr(run, name), getattr(again, name)) for name in ("gram", "places", "first", "last", "doc", "around"))


def test_merge():
    rng = np.random.default_rng(5)
    runs = [sorted({bytes(rng.integers(97, 99, rng.integers(1, 9)).tolist()) for _ in range(30)}) for _ in range(5)] + [[]]
    share = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    run, place, shared = passages.merge([(r, [0, *[share(a, b) for a, b in zip(r, r[1:], strict=False)]]) for r in runs])
    out = [runs[r][i] for r, i in zip(run, place, strict=True)]
    assert out == sorted(sum(runs, []))
    assert shared[1:] == [share(a, b) for a, b in zip(out, out[1:], strict=False)]


def test_licenses(spark, docs):
    texts = [t for some in licenses.TEMPLATES.values() for t in some] + licenses.GENERIC
    df = spark.createDataFrame([(i, f"Some words.\n{t}\nMore.") for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(df.union(docs.select("doc_id", "text").selectExpr("doc_id + 1000", "text"))).collect()}
    want = [f for f, some in licenses.TEMPLATES.items() for _ in some]
    assert [got[i] for i in range(len(want))] == want
    assert all(got[i] == "" for i in range(len(want), len(texts)))


# Opening notices as their authors break them.
WRAPPED = {
    "MIT": """Copyright (c) 2020 A. Name

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:""",
    "BSD-3-Clause": """/*
 * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:
 *
 * 1. Redistributions of source code must retain the above notice.
 */""",
    "GPL-3.0": """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.""",
    "MPL-2.0": """dnl This Source Code Form is subject to the terms of the Mozilla
dnl Public License, v. 2.0.""",
}


def test_wrapped_licenses(spark, docs):
    some = docs.orderBy("doc_id").limit(1).collect()[0]["text"]
    data = [(i, t, f) for i, (f, t) in enumerate(WRAPPED.items())] + [(10 + i, f"{some}\n{t}\n{some}", f) for i, (f, t) in enumerate(WRAPPED.items())]
    df = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(df.union(docs.selectExpr("doc_id + 1000", "text"))).collect()}
    assert [f for _, _, f in data] == [got[i]["license"] for i, _, _ in data]
    assert all(f in got[i]["licenses"].split(",") and got[i]["n_license"] > 0 for i, _, f in data)


def test_other_versions_are_no_confirmed_licenses(spark, docs):
    two = "Redistributions in binary form must reproduce the\nabove copyright notice."
    third = "Neither the name of the holder nor the names of its contributors may be used."
    other = [
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        WRAPPED["GPL-3.0"].replace("version 3", "version 2"),
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution 3.0 International License.",
        WRAPPED["MPL-2.0"].replace("2.0", "1.1"),
        f"{WRAPPED['BSD-3-Clause']}\n\n{two}",
    ]
    data = list(enumerate([*other, f"{WRAPPED['BSD-3-Clause']}\n\n{two}\n\n{third}"]))
    df = spark.createDataFrame(data, "doc_id long, text string").union(docs.selectExpr("doc_id + 1000", "text"))
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(df).collect()}
    assert [got[i] for i in range(len(data))] == ["GPL-2.0", "LGPL-2.1", "GPL-2.0"] + [""] * (len(other) - 3) + ["BSD-3-Clause"]  # versions 2 are families of their own


def test_common_license_words_stay_features():
    hot = [f"Copyright {1900 + i} Name{i}. Licensed under the Apache License 2.0" for i in range(100)]
    vocabulary, *_ = licenses.fit(hot + [f"some text {i}" for i in range(100)])
    assert set(vocabulary) == set().union(*(licenses.grams(t) for some in licenses.TEMPLATES.values() for t in some))


def test_needed_license_words_drop_no_case():
    rng = np.random.default_rng(2)
    for _ in range(20):
        weights = {f"g{i}": float(w) for i, w in enumerate(rng.normal(0.3, 1, 8))}
        common = licenses.Counter({g: int(rng.integers(0, 50)) for g in weights})
        needed = licenses.needed(weights, 1.5, common)
        for bits in range(256):
            has = {g for i, g in enumerate(weights) if bits >> i & 1}
            assert sum(weights[g] for g in has) <= 1.5 + 1e-9 or has & needed


def test_hot_license_wording_lifts_no_threshold(spark, docs):
    """A source whose documents say the licence in other words, and bring wrapped notices, hides no exact ones."""
    lines = [line for t in WRAPPED.values() for line in t.split("\n") if any(len(t & set(licenses.bigrams(line))) > 3 for t in licenses.TEMPLATE_BIGRAMS)]
    assert not any(map(licenses.known_negative, ["Licensed under Apache License 2.0", *lines]))
    hot = [f"Copyright {1900 + i} Name{i}. Licensed under Apache License 2.0\n{lines[i % len(lines)]}" for i in range(150)]
    exact = [t for some in licenses.TEMPLATES.values() for t in some]
    df = spark.createDataFrame(list(enumerate(exact + hot)), "doc_id long, text string").union(docs.selectExpr("doc_id + 1000", "text"))
    got = {r["doc_id"]: r["license"] for r in licenses.scan(df).collect()}
    assert [got[i] for i in range(len(exact))] == [f for f, some in licenses.TEMPLATES.items() for _ in some]
    own = [f"Name{i} other word{i}" for i in range(100)]
    _, _, plain = licenses.fit(own)
    _, _, thresholds = licenses.fit(own + hot)
    assert all(abs(thresholds[f] - plain[f]) < 0.05 for f in plain)


def test_langid_rejects_unlearned_languages_beside_rare_ones(spark):
    """However few texts a language has, texts of scripts that nothing was learned of are rejected, and its own aren't."""
    rng = np.random.default_rng(4)
    word = lambda first, n: "".join(chr(first + int(c)) for c in rng.integers(0, 24, n))
    cyrillic, greek = ([word(first, n) for n in rng.integers(2, 9, 60)] for first in (0x430, 0x3B1))
    text = lambda words: " ".join(rng.choice(words, 150))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    for n_rare in (1, 3, 40):
        rare = [(100_000 + i, text(cyrillic), "rare") for i in range(4 * n_rare)]
        unlearned = [(200_000 + i, text(greek), None) for i in range(5)]
        for table in (docs.union(spark.createDataFrame(rare + unlearned, docs.schema)), spark.createDataFrame(rare + unlearned, docs.schema)):
            model = langid.train(table)
            got = {r["doc_id"]: r for r in langid.predict(table, model).collect()}
            assert all(got[i]["rejected"] for i, _, _ in unlearned)
            assert not any(got[i]["rejected"] or got[i]["lang_pred"] != "rare" for i, _, _ in rare)


def test_packing_ids_are_those_of_the_library():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    strings = [t.content for t in library.get_added_tokens_decoder().values()]
    texts = [f(t) for t in strings for f in (lambda t: t, lambda t: f"some {t} text", lambda t: f"a{t}{t}b\n", str.upper, lambda t: t[:-1])] + ["plain text"]
    rng = np.random.default_rng(8)
    signs = [*"abcXYZ '.,!?s t re ve'm\n\t\x0b\x0c\r\x1c\x1d\x1f\x85\xa0\xad\u2003\u3000\x00\x7f09½²ªºéÉßİıſ日本\u0301--''\"", *strings, "don't", "we'll"]
    texts += ["".join(rng.choice(signs, rng.integers(0, 50))) for _ in range(3000)]
    texts += ["".join(map(chr, rng.integers(0, 0x180, 60))) for _ in range(3000)] + ["", " ", "x" * 50_000, "many words " * 5_000]
    with open(path, encoding="utf-8") as file:
        encoder = packing.Encoder(file.read())
    for begin in range(0, len(texts), 700):
        some = texts[begin : begin + 700]
        ids, bounds = encoder.encode(pa.array(some), [packing.END])
        assert strings and [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [[*library.encode(t, add_special_tokens=False).ids, packing.END] for t in some]


def test_url_rates_are_of_all_labelled_urls(spark):
    """A domain's labelled URLs count, whether or not the trees' sample has them."""
    part = lambda i: "b" if i % 2 else "a"
    known = [(1000 * i + k, f"http://d{i:03}.org/{part(i)}/{k}") for i in range(200) for k in range(5)]
    asked = [(-i - 1, f"http://d{i:03}.org/q/1") for i in range(200)]
    df = spark.createDataFrame(known + asked, "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(df, {"org/b/": "block", "org/a/": "allow"}, max_train=60).collect()}
    assert [got[-i - 1] for i in range(200)] == ["block" if i % 2 else "allow" for i in range(200)]


def test_url_weights_stand_for_copies():
    rng = np.random.default_rng(6)
    x, y, n = rng.integers(0, 30, (80, 3)).astype(float), rng.integers(0, 2, 80).astype(float), rng.integers(1, 9, 80)
    many = np.repeat(x, n, axis=0)
    for j in range(3):
        assert (urls.weighted_cuts(x[:, j], n) == np.unique(np.quantile(many[:, j], np.linspace(0, 1, urls.BINS + 1)[1:-1], method="lower"))).all()
    value = lambda t, row: t if isinstance(t, float) else value(t[2] if row[t[0]] <= t[1] else t[3], row)
    (a, some), (b, all_) = urls.fit_trees(x, y, n), urls.fit_trees(many, np.repeat(y, n))
    assert all(abs(a + sum(value(t, r) for t in some) - b - sum(value(t, r) for t in all_)) < 1e-6 for r in x)
