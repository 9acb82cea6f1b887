"""The pipeline on given tables against a brute-force version of each stage, judged on its own input."""

import re
import zlib
from collections import defaultdict

import pytest

import corpus_pipeline
from lexloom.llm import pii, quality_classifier
from lexloom.llm.common import table

DATA = "/root/testdata/sf0.01"


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def survivors(rows, n=5, percent=80):
    """Rows that stay: those of the smallest id of each class of texts whose shingles are alike, and those without words."""
    sets, having, above = {}, defaultdict(list), {}
    for i, text in rows.items():
        w = spaced(text)
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
        above[i] = i
        for s in sets[i]:
            having[s].append(i)

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for i, own in sets.items():
        shared = defaultdict(int)
        for s in own:
            for j in having[s]:
                shared[j] += j < i
        for j, both in shared.items():
            if both and 100 * both >= percent * (len(own) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                above[b] = a
    return {i for i in rows if top(i) == i}


def contaminated(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
    hit = set()
    for size, windows in items.items():
        for k in range(len(words) - size + 1):
            if tuple(words[k : k + size]) in windows:
                hit |= set(range(k, k + size))
    return bool(hit) and 20 * len(hit) >= len(words)


def windows_of(texts, n=13):
    out = defaultdict(set)
    for text in texts:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
        if w:
            size = min(n, len(w))
            out[size] |= {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, DATA, "documents").cache()


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_quality_keeps_what_held_out_labels_call_good(spark, docs):
    kept, labels = set(texts_of(corpus_pipeline.quality(spark, docs, DATA))), table(spark, DATA, "labels").filter("quality is not null").collect()
    held = [(r["doc_id"] in kept, r["quality"] == 1) for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(held) > 50 and sum(a == b for a, b in held) >= 0.95 * len(held)
    scores = quality_classifier.quality_scores(docs, table(spark, DATA, "labels"))
    assert kept == {r["doc_id"] for r in scores.filter("score >= 0.5").collect()}


def test_near_duplicates_against_brute_force(spark, docs):
    rows = texts_of(docs)
    stay = survivors(rows)
    assert 0 < len(stay) < len(rows)
    assert set(texts_of(corpus_pipeline.near_duplicates(spark, docs, DATA))) == stay


def test_contamination_against_brute_force(spark, docs):
    rows, items = texts_of(docs), windows_of(r["text"] for r in table(spark, DATA, "benchmark").collect())
    clean = {i for i, t in rows.items() if not contaminated(t, items)}
    assert 0 < len(clean) < len(rows)
    assert texts_of(corpus_pipeline.contamination(spark, docs, DATA)) == {i: rows[i] for i in clean}


def test_personal_data_leaves_all_else(spark, docs):
    rows, cleaned = texts_of(docs), texts_of(corpus_pipeline.personal_data(spark, docs, DATA))
    model, changed = pii.train(docs), 0
    assert rows.keys() == cleaned.keys()
    for i, text in rows.items():
        base = pii.base_spans(text or "")
        covered = bytearray(len(text or ""))
        for _, a, b in base + model.added(text or "", base):
            covered[a:b] = b"\1" * (b - a)
        # every covered run is one mark, and all else stays as it was
        plain = re.sub("\1+", "<PII>", "".join("\1" if c else x for x, c in zip(text or "", covered))) if text is not None else None
        assert cleaned[i] == plain
        assert plain is None or not pii.base_spans(plain)
        changed += plain != text
    assert changed > 20


def test_pipeline_against_its_stages(spark, docs, tmp_path):
    """run() is the stages one after the other, and its ids give back the texts."""
    kept = corpus_pipeline.quality(spark, docs, DATA)
    rows = texts_of(kept)
    items = windows_of(r["text"] for r in table(spark, DATA, "benchmark").collect())
    stay = {i for i in survivors(rows) if not contaminated(rows[i], items)}
    out = corpus_pipeline.run(spark, DATA)
    assert sorted(r["doc_id"] for r in out.select("doc_id").collect()) == sorted(stay)
    assert set(docs.columns) < set(out.columns)
    import sentencepiece

    from lexloom.llm.sentencepiece import MODEL

    plain = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = out.select("text", "piece_ids", "n_pieces").collect()
    for r in got:
        joined = "".join(plain.id_to_piece(i) for i in r["piece_ids"] or [])
        raw = re.sub(r"(?:<0x[0-9A-F]{2}>)+", lambda m: bytes.fromhex(m[0].replace("<0x", "").replace(">", "")).decode("utf-8", "replace"), joined)
        assert raw.replace("▁", " ").removeprefix(" ") == (r["text"] or "").replace("▁", " ").removeprefix(" ")
        assert r["n_pieces"] == len(r["piece_ids"] or [])
