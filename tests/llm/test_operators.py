"""Each operator on small tables: defined results for odd rows, and brute force."""

import hashlib
import random

import numpy as np
import pytest

from lexloom.llm import decontamination, html_extraction, lm_scoring, ngram_join, pii, quality_classifier, quality_rules, secrets, sentencepiece, suffix_dedup
from lexloom.llm.boosting import Gam

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, h string, score double"


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def texts():
    base = words(120, 1)
    near = base[:60] + ["other"] + base[61:]
    return [
        (1, " ".join(base)),
        (2, " ".join(near)),
        (3, " ".join(base)),
        (3, " ".join(base)),
        (4, None),
        (5, ""),
        (6, "two words"),
        (7, "x" * 9000),
        (8, "Écrire ▁ à a.b+c@mail.example.org ou +33 1 22 33 44 55, 10.0.0.7\n\npassword = hunter2hunter\t\U0001f600"),
        (9, " ".join(words(150, 2))),
        (None, "no id here at all"),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None, None if i == 6 else "s", None, "clash", 0.5) for i, t in texts()], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, " ".join(words(120, 1)[20:40])), (2, "two words"), (3, None), (4, "")], "item_id bigint, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (7, 0, 0), (8, None, 0)], "doc_id bigint, quality int, toxic int")


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_rows_stay_whole(spark, docs, bench, labels):
    empty = spark.createDataFrame([], SCHEMA)
    runs = {
        "op1": lm_scoring.lm_scores,
        "op2": pii.find_pii,
        "op3": sentencepiece.encode,
        "op4": quality_rules.quality_rules,
        "op5": lambda d: decontamination.contamination(d, bench),
        "op6": suffix_dedup.dedup,
        "op8": lambda d: quality_classifier.quality_scores(d, labels),
        "op9": secrets.find_secrets,
        "op10": ngram_join.cluster,
    }
    wanted = sorted(str(i) for i, _ in texts())
    for name, run in runs.items():
        assert sorted(str(r["doc_id"]) for r in run(docs).select("doc_id").collect()) == wanted, name
        assert run(empty).count() == 0, name


def test_pieces_round_trip(docs):
    for r in sentencepiece.encode(docs).collect():
        assert r["decoded"] == r["text"]


def test_units_are_found_by_slots():
    rng = np.random.default_rng(3)
    for h in (np.empty(0, np.int64), np.array([-5]), rng.integers(-(2**63), 2**63 - 1, 5_000), np.arange(-40, 40), np.append(rng.integers(-(2**63), -(2**62), 90), 2**63 - 1)):
        h = np.unique(h)
        known = sentencepiece.Paths(h, np.ones(len(h), np.uint8), np.arange(len(h)))
        asked = np.concatenate([h, h[:-1] + 1, [-(2**63), 0, 2**63 - 1]])
        at, there = known.find(asked)
        assert there.tolist() == np.isin(asked, h).tolist() and (h[at[there]] == asked[there]).all()


def test_pieces_are_not_copied_to_rows(docs):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = docs.sparkSession.conf.get(limit)
    plan = sentencepiece.encode(docs)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and docs.sparkSession.conf.get(limit) == before


def test_join_takes_texts_in_small_batches(docs, monkeypatch):
    limit, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    spark, shingled = docs.sparkSession, ngram_join.shingled
    spark.conf.set(limit, "10000")  # Spark's own; op3 leaves its own one
    monkeypatch.setattr(ngram_join, "shingled", lambda *a: seen.append(int(spark.conf.get(limit))) or shingled(*a))
    plain = sorted(map(str, ngram_join.cluster(docs, max_batch=2).collect()))
    assert seen and set(seen) == {2} and spark.conf.get(limit) == "10000"
    assert sorted(map(str, ngram_join.cluster(docs).collect())) == plain and set(seen) == {2, 1_000}


def test_join_against_brute_force(docs):
    got = by_id(ngram_join.cluster(docs))
    sets = {i: {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} for i, t in texts() if (w := (t or "").lower().split())}
    for i, rows in got.items():
        if i is None:
            continue
        linked = [j for j in sets if j is not None and i in sets and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])]
        assert {r["component_id"] for r in rows} == {min(linked, default=i)}
        assert {r["n_shingles"] for r in rows} == {len(sets.get(i, ()))}


def test_crowds_walked_again_give_the_same(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*words[: i % 7], f"x{i}", *words[i % 7 + 1 :]] if i % 3 else [*words, f"y{i}"])) for i in range(60)]
    docs = spark.createDataFrame([*rows, (60, None), (61, "")], "doc_id long, text string")
    plain = ngram_join.cluster(docs, 3, 80)
    again = ngram_join.cluster(docs, 3, 80, least_common=1, block=4, crowded=2)
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for i, t in rows}
    least = {i: i for i in sets}
    for _ in sets:
        for i, a in sets.items():
            for j, b in sets.items():
                if 100 * len(a & b) >= 80 * len(a | b):
                    least[i] = least[j] = min(least[i], least[j])
    want = sorted([(i, least[i]) for i in sets] + [(60, 60), (61, 61)])
    for got in (plain, again):
        assert sorted((r["doc_id"], r["component_id"]) for r in got.collect()) == want


def test_long_sets_are_dealt_into_blocks_by_their_shingles(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*words[: i % 7], f"x{i}", *words[i % 7 + 1 :]])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = lambda **options: sorted((r["doc_id"], r["component_id"]) for r in ngram_join.cluster(docs, 3, 80, **options).collect())
    assert found(block_shingles=100) == found() and ngram_join.Trie([ngram_join.np.arange(9), ngram_join.np.arange(10)], 80).keys[0].dtype.itemsize == 4


def test_trie_joins_what_pairs_would():
    import numpy as np

    r = random.Random(5)
    sets = []
    for _ in range(25):
        core = r.sample(range(500), 60)
        sets += [np.unique([*core[: 60 - k], *r.sample(range(500, 900), k)]) for k in range(4)]
    links = ngram_join.Trie(sets, 90).join()
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        assert len(np.intersect1d(sets[a], sets[b])) >= ngram_join.required(len(sets[a]), len(sets[b]), 90)
        root[find(a)] = find(b)
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(np.intersect1d(sets[a], sets[b])) >= 90 * len(np.union1d(sets[a], sets[b])):
                assert find(a) == find(b)


def test_suffixes_against_brute_force(docs):
    got, seen = by_id(suffix_dedup.dedup(docs.filter("doc_id is not null"))), {}
    for i, t in sorted({(i, t or "") for i, t in texts() if i is not None}):
        b, gone = t.encode(), bytearray(len(t.encode()))
        for p in range(len(b) - 99):
            s = b[p : p + 100]
            if s in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.setdefault(s, i)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        assert {r["kept_sha256"] for r in got[i]} == {hashlib.sha256(kept).hexdigest()}, i


def test_deep_shallow_sorts():
    r = random.Random(3)
    s = [bytes(r.choice(b"ab") for _ in range(r.randrange(40))) for _ in range(300)] + [b"aaaaaaaaaaaab"] * 4
    assert [s[i] for i in suffix_dedup.deep_shallow(s)] == sorted(s)


def test_many_contexts_as_few():
    r = random.Random(4)
    pool = [bytes(r.choice(b"xy") for _ in range(163)) for _ in range(4)]
    contexts = [(x[:63], x[100:]) for x in (bytearray(r.choice(pool)) for _ in range(60)) if not x.__setitem__(r.randrange(163), 122)]
    few, many = suffix_dedup.covered(contexts, 100, few=99), suffix_dedup.covered(contexts, 100, few=1)
    assert [suffix_dedup.merged(x) for x in few] == [suffix_dedup.merged(x) for x in many]


def test_contamination_counts(docs, bench):
    got = by_id(decontamination.contamination(docs, bench))
    assert [r["n_hit"] for r in got[1]] == [20] and got[1][0]["contaminated"]
    assert got[6][0]["n_hit"] == 2 and got[9][0]["n_hit"] == 0


def test_base_spans():
    t = texts()[8][1]
    assert [k for k, _, _ in pii.base_spans(t)] == ["email", "ip", "phone"]
    assert [(k, t[a:b]) for k, a, b in secrets.base_spans(t)] == [("assign", "password = hunter2hunter")]
    assert pii.emails("a@b.c_d@e.fg @x.y z@") == [("email", 0, 5), ("email", 5, 12)]
    assert pii.redact("ab cd ef", [("k", 0, 2), ("k", 1, 4)]) == "<PII>d ef"


def test_article_text(spark):
    rows = [(i, f"https://h.example/{i}", f"<html><body><nav><li>Home</li></nav><article><h1>T{i} &amp; x</h1><p>a<b>b</b>\n c<br>d<p>e</p><div class='ad'>buy</div></article><footer>f</footer></body></html>") for i in range(5)]
    rows += [(6, None, None), (7, "x", "")]
    got = {r["page_id"]: r for r in html_extraction.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[2]["text"] == "T2 & x ab c d e" and got[2]["n_chars"] == 15
    assert got[6]["text"] == "" and got[7]["n_chars"] == 0


def test_gam_learns_an_interaction():
    import numpy as np

    x = np.random.default_rng(1).random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((Gam(x[:2000], y[:2000]).score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9


def test_pairs_seen_once_count(spark):
    import numpy as np

    from lexloom.llm.quality_classifier import in_fold

    rows = [(i, " ".join(words(40, i, 60 + i))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    held = {r["doc_id"] for r in df.filter(in_fold(df["doc_id"], 10, 0)).collect()}
    one, two = {}, {}
    ended = {i: [None, *t.split(), None] for i, t in rows}
    for i, t in ended.items():
        for v, w in zip(t, t[1:]) if i not in held else ():
            one[w], two[v, w] = one.get(w, 0) + 1, two.get((v, w), 0) + 1
    assert 1 in two.values() and held
    stands = lambda c: float(lm_scoring.estimate(lm_scoring.levels(np.array([c])))[0]) if c else 0.0
    whole = sum(one.values()) + 0.1 * (len(one) + 1)
    p1 = lambda w: (one.get(w, 0) + 0.1) / whole
    for options in ({}, {"block_tokens": 90, "slice_tokens": 100}):
        got = by_id(lm_scoring.lm_scores(df, **options))
        for i, t in ended.items():
            p = [(stands(two.get((v, w), 0)) + 8 * p1(w)) / (one.get(v, 0) + 8) for v, w in zip(t, t[1:])]
            assert got[i][0]["score"] == pytest.approx(sum(np.log10(p))), i
            assert got[i][0]["base_score"] == pytest.approx(sum(np.log10(p1(w)) for w in t[1:])) and got[i][0]["n_known"] == sum(w in one for w in t[1:])
    # what follows a word has a probability of 1 at most
    for v in [*one][:20]:
        assert sum((stands(two.get((v, w), 0)) + 8 * p1(w)) / (one[v] + 8) for w in one) <= 1


def test_article_in_named_wrappers():
    text = lambda h: html_extraction.main_text(html_extraction.Page(h), None)
    for name in ("content-sidebar-wrap", "layout with-sidebar", "navy-theme", "no-ads", "sidebar", "content-header-wrap"):
        for tag in ("article", "main"):
            assert text(f"<body><div class='{name}'><{tag}><p>own words</p><div class='ad'>buy</div></{tag}></div></body>") == "own words", (name, tag)
        assert text(f"<body><div class='{name}'><p>quite a few own words here</p><div class='ad'>buy</div></div></body>") == "quite a few own words here", name
    assert text("<form id='f'><main>own</main></form>") == "own"
    assert text("<article><p>own text<div class='related-work'>and work</div><p class='ad'>buy<ul><li>point<li class='comment'>hm</ul></article>") == "own text and work point"
    assert text("<nav><div class='x'>a long list of links that is most of the page</div></nav><p>own</p><div class='notice'>c</div>") == "own"


def test_template_slots_without_article(spark):
    """The host's template tells its story slot from a list of links that is longer on one page."""
    links = lambda n: "".join(f"<li><a href='/{k}'>another story of today number {k}</a></li>" for k in range(n))
    page = lambda k, story, n: f"<html><body><div class='top'><ul>{links(n)}</ul></div><div class='story'><p>{story}</p></div><div class='foot'>about us</div></body></html>"
    rows = [(k, f"http://a.example/{k}", page(k, f"story {k} " + " ".join(words(40, k)), 3)) for k in range(8)]
    brief = "breaking: it rained"
    promo = "<div class='big'>" + " ".join(words(60, 99)) + "</div>"
    rows.append((8, "http://a.example/8", page(8, brief, 3).replace("<div class='foot'>", promo + "<div class='foot'>")))
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(spark.createDataFrame(rows + rows[:1], "page_id bigint, url string, html string")).collect()}
    assert got[3] == f"story 3 {' '.join(words(40, 3))}" and got[8] == brief
    alone = html_extraction.main_text(html_extraction.Page(rows[8][2]), None)
    assert alone != brief  # by itself, the page's longest slot would win
    assert html_extraction.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_many_contexts_of_an_anchor_by_strings(spark):
    r = random.Random(8)
    letters = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    core, edges = letters(80), [letters(70) for _ in range(5)]
    rows = [(i, letters(20) + r.choice(edges)[-r.randrange(5, 70) :] + core + r.choice(edges)[: r.randrange(5, 70)] + letters(20)) for i in range(40)]
    df, seen = spark.createDataFrame(rows, "doc_id bigint, text string"), {}
    got = [by_id(suffix_dedup.dedup(df, many=many)) for many in (3, 2000)]
    for i, t in rows:
        b, gone = t.encode(), bytearray(len(t))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.setdefault(b[p : p + 100], i)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        assert [g[i][0]["kept"] for g in got] == [kept, kept], i
    assert any(g["n_removed"] for rows in got[0].values() for g in rows)


def test_repeated_rows_are_one_document(spark):
    text = " ".join(words(80, 11))
    rows = [(1, text), (1, text), (2, "x " + text + " y"), (3, text[:300]), (3, text[100:500])]
    got = by_id(suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert [r["n_removed"] for r in got[1]] == [0, 0] and got[2][0]["kept"] == b"x  y"
    assert [r["n_removed"] for r in got[3]] == [300, 400 if len(text) >= 500 else len(text) - 100]


def planted_texts():
    """Texts with base personal data and secrets, and ordinary words and numbers."""
    r = random.Random(7)
    hexed = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    out = []
    for k in range(240):
        a = f"mail to {r.choice('abcdef')}{k}.x@host{k % 9}.example.org or call +{r.randrange(10, 99)} {r.randrange(1, 9)} {r.randrange(100, 999)} {r.randrange(1000, 9999)} today"
        b = f"token = {mixed(24)} and id {hexed(32)} but see AKIA{mixed(16).upper()}"
        out.append((k, " ".join([*words(30, k), a, b, *words(10, k + 500), f"on 2021-0{1 + k % 9}-11 at 10:{10 + k % 50}:00 some understandable-identifier_names"])))
    return out


def test_pii_adds_what_the_patterns_miss(spark):
    model = pii.train(spark.createDataFrame(planted_texts(), "doc_id bigint, text string"))
    found = lambda t: [t[a:b] for _, a, b in model.added(t, pii.base_spans(t))]
    assert found("please mail to a7.x (at) host3.example.org today") == ["a7.x (at) host3.example.org"]
    assert found("or call 0041 4 321 7654 today")
    assert not found("the meeting of 2023-05-17 began at 12:45:10 and cost 120 in all")
    assert not found(" ".join(words(400, 3)))
    assert len(pii.base_spans("9" * 40_000)) == 0  # and soon


def test_secrets_adds_keys_without_a_name(spark):
    model = secrets.train(spark.createDataFrame(planted_texts(), "doc_id bigint, text string"))
    t = "deploy with Zq8fK2pLX9Rt5Vw1bN7c now"
    assert [t[a:b] for _, a, b in model.added(t, secrets.base_spans(t))] == ["Zq8fK2pLX9Rt5Vw1bN7c"]
    assert not model.added("some understandable-identifier_names of w12 w13", [])


def test_spans_overlap():
    from lexloom.llm.spans import Taken

    taken = Taken([("k", 5, 8), ("k", 0, 2), ("k", 7, 9)])
    assert [taken.overlaps(a, a + 1) for a in range(10)] == [True, True, False, False, False, True, True, True, True, False]
    taken.add(3, 4)
    assert taken.overlaps(2, 4) and not taken.overlaps(4, 5)


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    base = " ".join(words(120, 21))
    near = base.replace(base.split()[60], "other")
    rows = [(i, t, None, None, None, "clash", 0.5, "q") for i, t in texts()]
    rows += [(11, base + " mail a.b@c.example.org", None, "s", 1, "x", 0.0, "q"), (12, near + " mail a.b@c.example.org", None, "s", 1, "x", 0.0, "q"), (12, "another text of the same id " + " ".join(words(60, 77)), None, "s", 1, "x", 0.0, "q")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, gone_id string, piece_ids double, `a.b` string")
    spark.createDataFrame([(1, " ".join(words(120, 1)[20:40]))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (7, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.drop("gone_id", "piece_ids", "a.b").write.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] or 0, (r["text"] or "")[:20]) for r in kept.collect())
    assert (12, "another text of the ") in ids and (12, near[:20]) not in ids and (11, base[:20]) in ids
    clean = corpus_pipeline.contamination(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {4, 5, 6, 7, 8, 9, None, 11, 12}
    cut = by_id(decontamination.decontaminate(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet"), action="spans"))
    want = words(120, 1)
    assert cut[1][0]["text"].split() == want[:20] + want[40:] and cut[9][0]["text"] == texts()[9][1]
    clean = by_id(corpus_pipeline.personal_data(spark, docs, str(tmp_path)))
    assert "<PII>" in clean[11][0]["text"] and clean[4][0]["text"] is None
    assert by_id(corpus_pipeline.pieces(spark, docs, str(tmp_path)))[4][0]["n_pieces"] == 0
    assert corpus_pipeline.quality(spark, docs, str(tmp_path)).columns == docs.columns
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "text", "piece_ids", "n_pieces"} <= set(out.columns) and out.count() > 0


def test_contamination_as_sql(spark):
    import duckdb

    from lexloom.llm import registry

    folder, c = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    for name, sql in registry.SQL.items():
        got, want = registry.queries()[name](spark, folder).toPandas(), c.sql(sql).df()
        cols = sorted(want.columns)
        assert sorted(map(str, got[cols].itertuples(index=False, name=None))) == sorted(map(str, want[cols].itertuples(index=False, name=None)))


def plain_pieces(text, cost, zero, worst):
    """The ids of the cheapest path over the whole text as one lattice; ties go to the shorter last piece, then to the smaller id."""
    u, best = " " + text, [(0, 0, None)]
    for end in range(1, len(u) + 1):
        tried = [(best[end - k][0] + c, k, i) for k in range(1, min(63, end) + 1) if (found := cost.get(u[end - k : end])) for c, i in [found]]
        if u[end - 1] not in cost:
            tried.append((best[end - 1][0] + len(u[end - 1].encode()) * (worst + 10_000), 1, None))
        best.append(min(tried, key=lambda x: x[:2] + (x[2] or 0,)))
    out, at = [], len(u)
    while at:
        _, k, i = best[at]
        out[:0] = [i] if i is not None else [zero + b for b in u[at - 1].encode()]
        at -= k
    return out


def test_pieces_against_plain_viterbi(docs):
    import math

    import sentencepiece as spm

    sp = spm.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    plain.sort(key=lambda i: (-sp.get_score(i), i))
    harmonic = math.log(sum(1 / (r + 200) for r in range(1, len(plain) + 1)))
    cost = {sp.id_to_piece(i).replace("▁", " "): (round(1000 * (math.log(r + 200) + harmonic)), i) for r, i in enumerate(plain, 1)}
    worst = max(c for c, _ in cost.values())
    wanted = {t: plain_pieces(t, cost, sp.piece_to_id("<0x00>"), worst) for _, t in texts() if t is not None}
    for head_words in (6_000_000, 3):  # all paths in the files; nearly all by the join
        for r in sentencepiece.encode(docs, head_words=head_words).collect():
            assert r["piece_ids"] == wanted.get(r["text"]) and r["decoded"] == r["text"], (head_words, r["doc_id"])


def test_base_scores_against_brute_force(docs):
    import math
    import re
    import zlib
    from collections import Counter

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [(i, [*re.findall("[^ \t-\r]+", (t or "").translate(lower)), None]) for i, t in texts()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    counts = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    wanted = {i: (held(i), len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for i, ws in tokens}
    for r in lm_scoring.lm_scores(docs).collect():
        *exact, base = wanted[r["doc_id"]]
        if r["doc_id"] is not None:
            assert [r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]] == exact
            assert r["base_score"] == pytest.approx(base)


def test_rules_as_sql(spark, docs):
    import duckdb

    from lexloom.llm.registry import SQL

    line = "one line of some words\n"
    more = [(20 + k, line * k + " ".join(words(60, k)) + " # $ " * (30 * (k % 3)), f"host{k % 2}") for k in range(8)]
    rows = docs.select("doc_id", "text", "source").unionByName(spark.createDataFrame(more, "doc_id bigint, text string, source string"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = [tuple(r) for r in quality_rules.quality_rules(rows).select(columns).collect()]
    con = duckdb.connect()
    con.register("documents", rows.toPandas())
    wanted = con.execute(f"select {', '.join(columns)} from (select case when isnan(doc_id) then null else doc_id::bigint end as doc_id, * exclude doc_id from ({SQL['op4_quality_rules']}))").fetchall()
    assert sorted(map(str, got)) == sorted(map(str, wanted))


def peak_bytes(work) -> int:
    import tracemalloc

    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_repeated_shingles_are_counted_in_place():
    """The task that counts shingles takes little more than the shingles themselves."""
    from collections import Counter

    made = lambda k: np.unique(np.random.default_rng(k).integers(0, 1 << 40, 5_000))
    sets = [np.array([1, 5, 9]), np.array([5, 9, 11]), np.array([2, 9]), np.empty(0, np.int64), np.array([5, 20])]
    plain = Counter(x for s in sets for x in s.tolist())
    (got,) = ngram_join.repeated(iter(sets), 100)
    assert dict(zip(got["token"], got["k"])) == {x: k for x, k in plain.items() if k > 1}
    assert sum(len(x) for x in ngram_join.repeated(iter(sets), 2)) == 0  # each set by itself
    assert list(ngram_join.repeated(iter([]), 10)) == []
    assert peak_bytes(lambda: list(ngram_join.repeated((made(k) for k in range(200)), 1_000_000))) < 1.5 * 8_000_000


def test_paths_take_little_more_than_they_hold():
    h = np.sort(np.random.default_rng(5).integers(-(2**63), 2**63 - 1, 2_000_000))
    known, sizes, ids = [], np.ones(len(h), np.uint8), np.arange(len(h), dtype=np.uint16)
    peak = peak_bytes(lambda: known.append(sentencepiece.Paths(h, sizes, ids)))
    bits = sentencepiece.slot_bits(len(h))
    assert np.array_equal(known[0].starts, np.arange(len(h) + 1))
    assert np.array_equal(known[0].slots, np.searchsorted(h, np.arange(-(1 << (bits - 1)), 1 << (bits - 1)) << (64 - bits)))
    assert peak < known[0].starts.nbytes + known[0].slots.nbytes + 3_000_000


@pytest.mark.parametrize("cells", [70, 1000, 100_000])
def test_contexts_give_one_range_each(cells, monkeypatch):
    """Strings around one gram overlap, so what they cover is one range, judged for many offsets at once."""
    monkeypatch.setattr(suffix_dedup, "CELLS", cells)
    r = random.Random(6)
    pool = [bytes(r.choice(b"xy") for _ in range(163)) for _ in range(4)]
    contexts = []
    for _ in range(60):
        x = bytearray(r.choice(pool))
        x[r.choice([*range(63), *range(100, 163)])] = 122
        contexts.append((bytes(x[r.randrange(20) : 63]), bytes(x[100 : 163 - r.randrange(20)])))
    gram, seen = pool[0][63:100], set()
    for (left, right), got in zip(contexts, suffix_dedup.covered(contexts, 100, few=1), strict=True):
        whole = left + gram + right
        strings = [(o, whole[len(left) - o :][:100]) for o in range(min(len(left), 63) + 1) if len(whole) - len(left) + o >= 100]
        again = [o for o, s in strings if (o, s) in seen]
        seen |= set(strings)
        assert got == ([(-max(again), 100 - min(again))] if again else [])
