"""Hard negatives, aligned tokens and licenses against brute force, and base spans against plain patterns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import decontamination, hard_negatives, html_extraction, licenses, pii, quality_classifier, secrets, token_alignment
from lexloom.llm.common import table

DATA = "/root/testdata/sf0.001"
VECTORS = "vec_id bigint, label int, vector array<bigint>, embedding string"


def negatives_of(rows):
    """Rows (vec_id, label, vector), each id once: every anchor with its positives and their negatives, by sorting all."""
    out = []
    for a, label, v in rows:
        if a % 50:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in rows), key=lambda s: s[:2])
        for s, i, _ in [x for x in scored if x[2] == label and x[1] != a][:5]:
            fit = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(a, i, n, j, -s, -t) for n, (t, j, _) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash") for r in rows], VECTORS).repartition(3)
    return sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 50 == 0, **options).collect()))


def test_hard_negatives_against_brute_force(spark):
    r = random.Random(1)
    centres = [[r.randrange(-40, 60) for _ in range(7)] for _ in range(6)]
    rows = [(k, r.randrange(3), [x + r.randrange(-9, 10) for x in centres[k % 6]]) for k in range(400)]
    rows += [(1000 + k, 1, rows[50][2]) for k in range(120)]  # a third of one kind, all tied
    want = negatives_of(rows)
    assert len(want) > 50
    small = {"codes": 4, "block": 16, "first": 40, "sample": 64}
    assert mined(spark, rows) == want and mined(spark, rows, **small) == want
    # repeated rows count once, rows of another length take no part
    assert mined(spark, rows + rows[:80] + [(2000, 1, [1, 2]), (2050, 2, [])], **small) == want


def test_hard_negatives_of_odd_tables(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, 0, [1, 2])]) == []
    assert mined(spark, [(50, 0, [0]), (51, 0, [0]), (52, 1, [0])]) == [(50, 51, 1, 52, 0, 0)]
    below = [(50, 0, [1]), (51, 0, [-100]), (52, 1, [-60])]  # no window below zero
    assert mined(spark, below) == []
    with pytest.raises(ValueError, match="doubles"):
        mined(spark, [(50, 0, [2**30] * 3)])
    odd = [(1, 0, [0.5, float("nan")]), (2, 0, [0.5, None]), (3, None, [0.5, 1.0]), (4, 0, None), (None, 0, [1.0, 1.0]), (5, 0, [float("inf"), 0.0]), (6, 0, []), (7, 3, [0.5, -0.001])]
    whole = hard_negatives.whole_vectors(spark.createDataFrame(odd, "vec_id bigint, label int, embedding array<float>")).collect()
    assert [tuple(x) for x in whole] == [(7, 3, [128, -1])]


def test_bounds_leave_cells_out():
    """The heap gives cells by falling bounds, each once; what it leaves out can't be needed."""
    r = np.random.default_rng(3)
    middle = r.normal(0, 200, (8, 6))
    points = np.concatenate([m + r.normal(0, 4, (60, 6)) for m in middle])
    books = [hard_negatives.codebook(points[:, :3], 8), hard_negatives.codebook(points[:, 3:], 8)]
    near = [hard_negatives.nearest(points[:, :3], books[0]), hard_negatives.nearest(points[:, 3:], books[1])]
    radii = [np.array([max([0, *np.linalg.norm(x[n == k] - b[k], axis=1)]) for k in range(8)]) for x, n, b in ((points[:, :3], near[0], books[0]), (points[:, 3:], near[1], books[1]))]
    counts = np.bincount(near[0] * 8 + near[1], minlength=64)
    index = hard_negatives.Index(books, radii, counts, 16)
    bounds = index.bounds(points[:20])
    for k in range(20):
        order = list(hard_negatives.visited((bounds[0][0][k], bounds[1][0][k])))
        assert len({c[1:] for c in order}) == 64 and all(a[0] >= b[0] for a, b in zip(order, order[1:]))
        scores = points @ points[k]
        need = np.sort(scores)[-5]
        reached = {i * 8 + j for bound, i, j in order if bound >= need}
        assert {near[0][p] * 8 + near[1][p] for p in np.flatnonzero(scores >= need)} <= reached
        asked = index.blocks(bounds, k, need, np.inf, 0, None)
        assert len(asked) < index.first.max() / 2  # most cells aren't visited


def links_of(wa, wb):
    """All pairs of tokens whose byte ranges overlap, by comparing every two."""
    spans = lambda ws: [(sum(ws[:k]), sum(ws[: k + 1])) for k in range(len(ws))]
    return [(i, j) for i, (s, e) in enumerate(spans(wa)) for j, (t, f) in enumerate(spans(wb)) if s < f and t < e]


def test_token_alignment_against_brute_force(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    one, two = Tokenizer.from_file(token_alignment.BYTE_MODEL), sentencepiece.SentencePieceProcessor(model_file=token_alignment.PIECE_MODEL)
    one.encode_special_tokens, signs = True, token_alignment.byte_signs()
    held = [r["text"] for r in table(spark, DATA, "documents").orderBy("doc_id").limit(25).collect()]
    texts = [*[t[:600] if t else t for t in held], None, "", " ", "a", "<|endoftext|> and <s></s>", "▁ blank sign", "\U0001f600\n\n\tnaïve  中文", "aa" * 300, "two two two", "two two two", "don't  stop \r\n"]
    want, count = [], Counter()
    for text in texts:
        a = b = wa = wb = []
        if text:
            e, b = one.encode(" " + text, add_special_tokens=False), two.encode(text)
            a, wa = e.ids, [bytes(signs[c] for c in t) for t in e.tokens]
            wb = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(wa) != (" " + text).encode() or b"".join(wb) != (" " + text).encode():
                a = b = wa = wb = []
        ends = [np.cumsum([len(w) for w in ws]).tolist() for ws in (wa, wb)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, i, j = [], 0, 0
        for c in cuts:
            x, y = ends[0].index(c) + 1, ends[1].index(c) + 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            i, j = x, y
        links = [(a[i], b[j]) for i, j in links_of([len(w) for w in wa], [len(w) for w in wb])]
        count.update(set(links))
        want.append((len(a), len(b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    top = Counter()
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    rows = [(k, na, nb, ng, len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), sha) for k, (na, nb, ng, links, sha) in enumerate(want)]
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id bigint, text string, row string").repartition(3)
    for head in (token_alignment.HEAD, 30, 0):  # all pairs known, few, none: the rest is joined
        assert sorted(map(tuple, token_alignment.align(df, head=head).collect())) == rows
    assert rows[30][1] == 0 and rows[29][1] > 3  # a sign that pieces give back as a blank; names of special tokens as text
    assert [tuple(r) for r in token_alignment.align(df.limit(0)).collect()] == []
    nulls = spark.createDataFrame([(None, "one word"), (None, None)], "doc_id bigint, text string")
    assert sorted(r["n_a"] for r in token_alignment.align(nulls).collect()) == [0, 2]


def test_runs_skip_along_diagonals():
    r = random.Random(4)
    for _ in range(300):
        n = r.randrange(1, 60)
        a, b = (sorted({*(x for x in range(1, n) if r.random() < 0.8), n}) for _ in range(2))
        found = [(i + k, j + k) for i, j, m in token_alignment.runs(a, b) for k in range(m)]
        assert found == [(a.index(x), b.index(x)) for x in sorted(set(a) & set(b))]


PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def test_licenses_against_brute_force(spark):
    r = random.Random(5)
    bits = ["Under the MIT License", "apache-license, VERSION 2.0", "CC BY-NC 4.0", "mit", "under", "the", "license", "cc by", "été", "by nc", "\n", "..."]
    texts = [" ".join(r.choice(bits) for _ in range(r.randrange(30))) for _ in range(200)] + [None, "", "...", "cc by nc" * 3, "İ MIT", "x " * 50_000 + "under the MIT license"]
    texts += [t["text"] for t in table(spark, DATA, "documents").collect()]
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id bigint, text string, labels string")
    got = {x["doc_id"]: x for x in licenses.find_licenses(df).collect()}
    for k, text in enumerate(texts):
        lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        places = [(i, label) for label, p in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        x = got[k]
        assert (x["n_words"], x["n_base"]) == (len(words), len(places))
        assert (x["first_word"], x["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert x["base_labels"] == ",".join(sorted({p[1] for p in places})) and set(x["base_labels"].split(",")) <= {*x["labels"].split(","), ""} and 0 <= x["score"] <= 1
        for label, s, e in (p.rsplit(":", 2) for p in x["spans"].split(",") if p):
            assert 0 <= int(s) < int(e) <= len(words) and label in x["labels"].split(",")


@pytest.mark.parametrize(
    ("text", "labels", "spans"),
    [
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3", "gpl-3:3:12"),
        ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3", "bsd-3:0:6"),
        ("see https://opensource.org/licenses/MIT and https://creativecommons.org/licenses/by-sa/4.0/", "cc-by-sa,mit", "mit:2:6,cc-by-sa:8:15"),
        ("Licensed under the GNU Lesser General Public License v2.1", "lgpl-2.1", "lgpl-2.1:0:10"),  # not gpl, not lgpl
        ("Creative Commons Attribution-NonCommercial-ShareAlike", "cc-by-nc-sa", "cc-by-nc-sa:0:5"),
        ("CC BY-SA", "cc-by-sa", "cc-by-sa:0:3"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit", "mit:0:13"),
        ("der Zug kommt mit der Bahn, license of poets, general public", "", ""),
    ],
)
def test_license_rules(text, labels, spans):
    *_, got, _, found = licenses.scan(text)
    assert (got, found) == (labels, spans) and len(licenses.rules()) > 200


def test_rules_are_gated_by_their_keywords():
    """Whatever a rule's name matches has one of its keywords."""
    for label, names, short in licenses.FAMILIES:
        for name in re.split(r"\|(?![^(]*\))", names):
            plain = re.sub(r"\(\?:([^|)]*)[^)]*\)\??|\[(.)[^\]]*\]|(.)\?", lambda m: m[1] or m[2] or m[3] or "", name)
            spans = licenses.detections(b" %s " % plain.encode())
            assert spans and any(w in plain.encode() for w in licenses.gate()), (label, plain)
        assert licenses.scan(f"spdx license identifier {short}")[5], label


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def fits(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        doubled = [int(c) * (2 if k % 2 else 1) for k, c in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def test_pii_base_is_that_of_plain_patterns(spark):
    docs = table(spark, DATA, "documents")
    got = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    some = Counter()
    for r in docs.collect():
        spans = [(k, m.start(), m.end()) for k, p in KINDS.items() for m in re.finditer(p, r["text"] or "") if fits(k, m[0])]
        x = got[r["doc_id"]]
        some.update(k for k, *_ in spans)
        assert x["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert [x[f"n_{k}"] for k in KINDS] == [sum(s[0] == k for s in spans) for k in KINDS]
    assert len(some) >= 3


SECRETS = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def test_secrets_base_is_that_of_plain_patterns(spark):
    docs = table(spark, DATA, "documents")
    got = {r["doc_id"]: r for r in secrets.find_secrets(docs).collect()}
    long = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}
    kinds = list(SECRETS)
    for r in docs.collect():
        spans = [(m.start(), kinds.index(k), m.end()) for k, p in SECRETS.items() for m in re.finditer(p, r["text"] or "") if long[k](m)]
        x = got[r["doc_id"]]
        assert x["base_sha256"] == hashlib.sha256(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans)).encode()).hexdigest()
        assert [x[f"n_{k}"] for k in kinds] == [sum(s[1] == n for s in spans) for n in range(3)]


def test_held_out_labels_never_matter(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = lambda x: sorted((r["doc_id"], r["score"]) for r in quality_classifier.quality_scores(docs, x).collect())
    assert scores(labels) == scores(turned) == scores(labels.filter(~held))


ARTICLE = "<p>" + "One sentence of the article. " * 20 + "</p>"


@pytest.mark.parametrize(
    ("inner", "kept"),
    [
        ('<section id="comments-list"><p>noise</p></section>', False),
        ('<div class="comments-section"><p>noise</p></div>', False),
        ('<div class="cookie-banner">noise</div>', False),
        ('<div class="ad-slot">noise</div>', False),
        ('<div class="userComments">noise</div>', False),
        ('<div id="ad_unit_3">noise</div>', False),
        ("<header><h1>noise</h1></header>", True),
        ("<header><p>noise</p></header>", False),
        ("<header><nav><h2>noise</h2></nav></header>", False),
        ('<div class="has-sidebar">noise</div>', True),
        ('<div class="no-ads navy-theme">noise</div>', True),
        ('<div class="comment-free-zone">noise</div>', True),
    ],
)
def test_what_an_article_keeps(inner, kept):
    page = html_extraction.Page(f"<header><h1>site</h1></header><article>{inner}{ARTICLE}</article><footer>foot</footer>")
    text = html_extraction.main_text(page, None)
    assert ("noise" in text) == kept and "One sentence" in text and "site" not in text and "foot" not in text


def test_contamination_without_broadcast(spark):
    """Hashes joined by a shuffle, very long texts among the documents: as with the broadcast."""
    item = " ".join(f"b{k}" for k in range(30))
    long = " ".join(f"w{k % 977}" for k in range(100_000))
    docs = spark.createDataFrame([(1, f"{long} {item} {long}"), (2, item), (2, item), (3, long), (4, None), (None, f"x {item[: item.index('b14')]}")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, item), (8, "w1 w2"), (None, item)], "item_id bigint, text string")
    rows = lambda **o: sorted(map(str, decontamination.contamination(docs, bench, **o).select("doc_id", "n_words", "n_hit", "items", "contaminated").collect()))
    got = rows(max_broadcast_windows=0)
    assert got == rows() and len(got) == 6
    pairs = sum((k % 977, (k + 1) % 977) == (1, 2) for k in range(99_999))
    assert f"doc_id=1, n_words=200030, n_hit={30 + 2 * 2 * pairs}, items=['7', '8'], contaminated=False" in got[0] + got[1] and sum("n_hit=30" in r for r in got) == 2
