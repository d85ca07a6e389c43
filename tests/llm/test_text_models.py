"""Filter audit, alignment and discriminant against brute force, and their results on odd rows."""

import bisect
import hashlib
import math
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm import alignment, audit, discriminant, queries

SF = "/root/testdata/sf0.001"
LONG = "ein  langer\tText\n\nmit Zeilen " * 4000
ODD = [None, "", " ", " \n\t", "one", "x" * 30_000, LONG, "日本語の　 テキスト 🎉", "a b c", "a b c", "LOUD WORDS! #1", "sp▁ace", "say <|endoftext|> or <s> </s> <0x41>", "don't\r\n it's\x0b\x0cno \xa0 a  b\x85 c\x1c d\x00 e  "]
PATHS = [queries.tokenizer_path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i % 3 else None, "d", "p", 7) for i, t in enumerate(ODD)] + [(4, "one", "en", "d", "p", 7), (4, "two", "en", "d", "p", 7), (None, "one", "de", "d", "p", 7), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, digest string, part string, block int")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, None), (9, None, 1), (None, 1, 1), (8, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, rows, labels, [tuple(r) for r in labels.collect()]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


# Filter audit


def plain_audit(rows: list[tuple], labels: list[tuple]) -> set[tuple]:
    space = " \t\n\x0b\x0c\r"
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    smallest: dict = {}
    for i, t, *_ in rows:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    parts = defaultdict(list)
    for i, t, lang, *_ in rows:
        t = t or ""
        words = "".join(" " if c in space else c for c in t).split(" ")
        words = [w for w in words if w]
        fails = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in t for c in "#$%&*|"), i is not None and smallest[t] < i)
        parts[lang or ""].append(({f for f, x in zip("ABCDE", fails, strict=True) if x}, i in good, i in toxic))
    out = []
    for part, docs in parts.items():
        for order in permutations("ABCDE"):
            for step, f in enumerate(order):
                before = set(order[:step])
                gone = [d for d in docs if f in d[0] and not d[0] & before]
                kept = sum(not d[0] & (before | {f}) for d in docs)
                out.append((part, "".join(order), step + 1, kept, len(gone), sum(f in d[0] and bool(d[0] & before) for d in docs), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)))
    shapley = Counter()
    for part, order, step, _, removed, *_ in out:
        shapley[part, order[step - 1]] += removed
    return {(*r, shapley[r[0], r[1][r[2] - 1]]) for r in out}


def test_audit_on_odd_rows(odd):
    docs, rows, labels, label_rows = odd
    out = [tuple(r) for r in audit.audit(docs, labels).collect()]
    assert len(out) == 3 * 600
    assert set(out) == plain_audit(rows, label_rows)


def test_audit_of_no_rows(odd):
    docs, _, labels, _ = odd
    assert audit.audit(docs.limit(0), labels).collect() == []


def test_audit_in_several_packs(odd, monkeypatch):
    docs, rows, labels, label_rows = odd
    monkeypatch.setattr(audit, "PACKED_ROWS", 3)
    assert {tuple(r) for r in audit.audit(docs, labels).collect()} == plain_audit(rows, label_rows)


def test_bitmaps_of_many_parts():
    rng = np.random.default_rng(3)
    part, fails = rng.integers(0, 300, 5000), rng.integers(0, 32, 5000)
    good, toxic = rng.random(5000) < 0.5, rng.random(5000) < 0.1
    part[part == 17] = 18  # a part without rows
    maps = audit.Bitmaps(part, 301, fails, good, toxic)
    assert 17 not in maps.parts and 300 not in maps.parts
    for first, then in ((0, 0), (5, 1), (0b11110, 0), (0b01111, 4)):
        left, now = fails & first == 0, fails >> then & 1 == 1
        want = [left & ~now, left & now, ~left & now, fails == 1 << then, left & now & good, left & now & toxic]
        assert [x.tolist() for x in maps.after(first, then)] == [[int(np.sum(w & (part == p))) for p in maps.parts] for w in want]


# Alignment


def byte_of() -> dict[str, int]:
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


def plain_tokens(libraries, text: str):
    a, b = libraries
    own = byte_of()
    a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    a_raw = [bytes(own[c] for c in a.id_to_token(x)) for x in a_ids]
    b_raw = [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in b_ids]
    return (a_ids, a_raw), (b_ids, b_raw)


def plain_alignment(libraries, texts: list[str | None]) -> list[tuple]:
    docs, count = [], Counter()
    for text in texts:
        if not text:
            docs.append(None)
            continue
        (a_ids, a_raw), (b_ids, b_raw) = plain_tokens(libraries, text)
        if not b"".join(a_raw) == b"".join(b_raw) == (" " + text).encode():
            docs.append(None)
            continue
        a_end, b_end = ([sum(map(len, raw[: k + 1])) for k in range(len(raw))] if len(raw) < 500 else np.cumsum(list(map(len, raw))).tolist() for raw in (a_raw, b_raw))
        links, low = [], 0
        for k, piece in enumerate(a_raw):
            while b_end[low] <= a_end[k] - len(piece):
                low += 1
            at = low
            while at < len(b_ids) and b_end[at] - len(b_raw[at]) < a_end[k]:
                links.append((a_ids[k], b_ids[at]))
                at += 1
        groups, i, j = [], 0, 0
        for cut in sorted(set(a_end) & set(b_end)):
            m, n = bisect.bisect_right(a_end, cut), bisect.bisect_right(b_end, cut)
            groups.append(",".join(map(str, a_ids[i:m])) + "|" + ",".join(map(str, b_ids[j:n])))
            i, j = m, n
        docs.append((len(a_ids), len(b_ids), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        count.update(set(links))
    best: dict = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    zero = (0, 0, 0, 0, 0, 0, "")
    return [zero if d is None else (*d[:3], len(d[3]), sum(count[x] == best[x[0]] for x in d[3]), sum(count[x] for x in d[3]), d[4]) for d in docs]


def test_alignment_of_documents(spark, libraries):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = sorted((r[0], *x) for r, x in zip(rows, plain_alignment(libraries, [r[1] for r in rows]), strict=True))
    assert sorted(tuple(r) for r in queries.op12_alignment(spark, SF).collect()) == want


@pytest.mark.parametrize(("block_bytes", "most_pairs"), [(50, 4_000_000), (24_000_000, 4_000_000), (500, 0)])
def test_alignment_of_odd_rows(odd, libraries, monkeypatch, block_bytes, most_pairs):
    docs, rows, *_ = odd
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(alignment, "MOST_PAIRS", most_pairs)
    want = sorted(((r[0], *x) for r, x in zip(rows, plain_alignment(libraries, [r[1] for r in rows]), strict=True)), key=str)
    assert sorted((tuple(r) for r in alignment.align(docs, *PATHS).collect()), key=str) == want
    assert sum(r[7] == "" for r in want) == 4  # null twice, empty, and U+2581
    assert alignment.align(docs.limit(0), *PATHS).collect() == []


@pytest.fixture(scope="module")
def tools():
    with open(PATHS[0], encoding="utf-8") as a, open(PATHS[1], "rb") as b:
        return alignment.Tokenizers(a.read(), b.read())


def test_breaks_are_those_the_vocabularies_allow(tools):
    assert set(" \n\t") <= set(tools.safe_breaks())
    assert "\r" not in tools.safe_breaks()  # B has tokens of punctuation and a carriage return


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab Z9'st.;{}\n\r\t\x0b\x0c\xa0 　\x1c\x85é日🎉_#"), min_size=1, max_size=40))
def test_segments_tokenise_like_the_text(tools, libraries, text):
    segments = alignment.segment_pattern(tools.safe_breaks()).findall(" " + text)
    assert "".join(segments) == " " + text
    cutter = alignment._Cutter(tools.safe_breaks())
    codes = cutter.cut(pa.array(["", text, "other words", text]))
    known = list(cutter.index)
    assert [[known[i] for i in c] for c in codes] == [[], segments, [" other", " words"], segments]
    a, b = libraries
    assert [i for s in segments for i in tools.a.encode(s, add_special_tokens=False).ids] == a.encode(" " + text, add_special_tokens=False).ids
    assert [i for s in segments for i in tools.b.encode(s)] == b.encode(text)


# Discriminant


def test_statistics_of_an_empty_text():
    assert discriminant.statistics(b"") == discriminant.statistics(b"")
    assert all(map(math.isfinite, discriminant.statistics(b"") + discriminant.statistics(b" \n ") + discriminant.statistics(b"!!")))


def test_discriminant_equals_plain_densities():
    rng = np.random.default_rng(5)
    d = len(discriminant.STATISTICS)
    x = [rng.normal(0, 1, (60, d)), rng.normal(0.5, 2, (90, d))]
    total = np.array([np.column_stack([np.ones(len(v)), v]).T @ np.column_stack([np.ones(len(v)), v]) for v in x])
    model = discriminant.Discriminant(total, 0.3, 0.1)
    pooled = (np.cov(x[0].T, bias=True) * 60 + np.cov(x[1].T, bias=True) * 90) / 150
    scale = np.sqrt(np.diag(pooled))
    probe, logs = rng.normal(0, 2, (20, d)), []
    for v in x:
        s = (0.7 * np.cov(v.T, bias=True) + 0.3 * pooled) / np.outer(scale, scale)
        s = 0.9 * s + 0.1 * np.trace(s) / d * np.eye(d)
        away = (probe - v.mean(axis=0)) / scale
        logs.append(math.log(len(v) / 150) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * (away @ np.linalg.inv(s) * away).sum(axis=1))
    assert np.allclose(model.scores(probe), logs[1] - logs[0])


def test_sums_and_folds_equal_plain_ones(spark):
    """What Spark adds up over all labelled rows, and the scores out of fold, against one array in memory."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = discriminant.labelled(discriminant.with_statistics(docs), labels)
    every = rows.collect()
    x, good, fold = np.array([r["stats"] for r in every]), np.array([r["good"] for r in every]), np.array([r["fold"] for r in every])
    total = discriminant.sums(rows)
    ones = np.column_stack([np.ones(len(x)), x])
    assert all((total[f, g] == ones[(fold == f) & (good == g)].T @ ones[(fold == f) & (good == g)]).all() for f in range(discriminant.FOLDS) for g in (0, 1))
    got = discriminant.scores_out_of_fold(rows, total)
    for i in (0, 7):
        want = np.zeros_like(got[i])
        for f in range(discriminant.FOLDS):
            own = [ones[(fold != f) & (good == g)] for g in (0, 1)]
            model = discriminant.Discriminant(np.array([v.T @ v for v in own]), *discriminant.SHRINK[i])
            np.add.at(want, (good[fold == f], discriminant.bins(model.scores(x[fold == f]))), 1)
        assert np.abs(np.cumsum(got[i], axis=1) - np.cumsum(want, axis=1)).max() <= 1  # a score at a bin's edge may fall either way


def test_discriminant_on_held_out_rows(spark):
    out = {r["doc_id"]: r for r in queries.op13_discriminant(spark, "/root/testdata/sf0.01").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in out if out[i]["held_out"]} == {i for i in out if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([out[i]["predicted"] == labels[i] for i in held]) >= 0.97
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in out.values())


def test_discriminant_learns_nothing_of_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end as quality")
    assert sorted(map(tuple, discriminant.judge(docs, labels).collect())) == sorted(map(tuple, discriminant.judge(docs, turned).collect()))


def test_discriminant_on_odd_rows(spark, odd):
    docs, rows, labels, _ = odd
    for known, only in ((labels.limit(0), 0.5), (labels.where("doc_id = 8"), 1.0), (spark.createDataFrame([(8, 0, 0), (9, 0, 0), (8, 1, 0)], labels.schema), 0.0)):
        out = discriminant.judge(docs, known).collect()
        assert len(out) == len(rows) and {r["score"] for r in out} == {only}
    out = discriminant.judge(docs, spark.createDataFrame([(i, i % 2, 0) for i in range(14)], labels.schema)).collect()
    scores = defaultdict(set)
    for r in out:
        scores[r["doc_id"]].add(r["score"])
    assert len(out) == len(rows) and scores[0] == scores[1] and scores[8] == scores[9] and all(0 <= s <= 1 for x in scores.values() for s in x)
    assert discriminant.judge(docs.limit(0), labels).collect() == []
