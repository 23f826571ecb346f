"""Hard negatives, whitening and quality rules against plain numpy and Python; mended draws, samples and page texts."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangeflow.llm import extract, langid, minhash, mixing, negatives, quality, toxicity, whitening

EXTRA = {"row": "x", "x": "y", "anchor": "z", "n": "w", "chunk": "v", "component": "u"}


# -- 11 hard negatives -------------------------------------------------------------------------------


def plain_negatives(rows, k=5, low=80, high=100):
    """rows: (id, vector, label); every row with an id divisible by 100 asks."""
    order = lambda r: math.inf if r is None else r
    out = Counter()
    for a, (aid, ax, al) in enumerate(rows):
        if aid is None or aid % 100:
            continue
        scored = [(sum(p * q for p, q in zip(ax, x, strict=True)), i, label) for b, (i, x, label) in enumerate(rows) if b != a]
        for ps, pid, _ in sorted((s for s in scored if s[2] == al), key=lambda s: (-s[0], order(s[1])))[:k]:
            window = [s for s in scored if s[2] != al and low * ps <= 100 * s[0] <= high * ps]
            for rank, (ns, nid, _) in enumerate(sorted(window, key=lambda s: (-s[0], order(s[1])))[:k], 1):
                out[(aid, pid, rank, nid, ps, ns)] += 1
    return out


def vectors(seed, n, d, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 60, (3, d))
    x = (centres[rng.integers(3, size=n)] + rng.normal(0, spread, (n, d))).astype(int)
    rows = [(i * 10, [int(c) for c in v], int(rng.integers(3))) for i, v in enumerate(x)]
    return rows + [rows[10], rows[10], (None, rows[3][1], 1), (5, rows[10][1], 2), (7, rows[10][1], rows[10][2])]


@pytest.mark.parametrize("d,spread", [(7, 40), (16, 3), (1, 20)])
def test_negatives_equal_plain_search(spark, monkeypatch, d, spread):
    monkeypatch.setattr(negatives, "ROW_BLOCK", 40)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 6)
    monkeypatch.setattr(negatives, "STEP", 4)
    rows = vectors(d, 250, d, spread)
    df = spark.createDataFrame([(*r, *EXTRA.values()) for r in rows], "vec_id bigint, vector array<bigint>, label int, " + ", ".join(f"`{c}` string" for c in EXTRA))
    found = negatives.hard_negatives(df, "vec_id", "vector", "label", df["vec_id"] % 100 == 0)
    assert Counter(map(tuple, found.collect())) == plain_negatives(rows)


def test_bounds_hold_every_score():
    rng = np.random.default_rng(2)
    x = rng.integers(-300, 300, (500, 13))
    centroids = negatives.fit_centroids(x[:60].astype(float))
    codes, norms = negatives.encode(x, centroids)
    lower, upper = negatives.bounds(x[:40], codes, norms, centroids)
    score = x[:40] @ x.T
    assert (lower <= score).all() and (score <= upper).all()
    assert (upper - lower).mean() < 0.9 * 2 * np.linalg.norm(x[:40], axis=1).mean() * np.linalg.norm(x, axis=1).mean()


def test_awkward_vectors(spark):
    schema = "vec_id bigint, vector array<bigint>, label int"
    ask = lambda rows: negatives.hard_negatives(spark.createDataFrame(rows, schema), "vec_id", "vector", "label", F.col("vec_id") % 100 == 0)
    assert ask([]).count() == 0
    assert ask([(0, [1, 2], 1), (1, [1, 2], 2)]).count() == 0  # no other row of the label
    rows = [(0, [5, 2], 1), (1, [5, 2], 1), (2, [5, 2], 2), (3, None, 2), (4, [5, 2], None), (6, [5, None], 2)]
    assert [tuple(r) for r in ask(rows).collect()] == [(0, 1, 1, 2, 29, 29)]
    with pytest.raises(ValueError, match="components"):
        ask([(0, [1], 1), (1, [1, 2], 1)])


# -- 12 whitening ------------------------------------------------------------------------------------


def test_whitening_equals_plain_decomposition(spark):
    rng = np.random.default_rng(4)
    x = (rng.normal(0, 1, (300, 9)) @ rng.normal(0, 40, (9, 9))).astype(int)
    rows = [(i, [int(c) for c in v]) for i, v in enumerate(x)] + [(7, [int(c) for c in x[7]]), (None, [int(c) for c in x[8]])]
    got = whitening.whiten(spark.createDataFrame([(*r, *EXTRA.values()) for r in rows], "vec_id bigint, vector array<bigint>, " + ", ".join(f"`{c}` string" for c in EXTRA)), "vec_id", "vector").collect()
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    values, axes = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    assert Counter((r["vec_id"], r["component"]) for r in got) == Counter((i, k) for i, _ in rows for k in range(1, 5))
    by_id = dict(rows)
    for k in range(4):
        mine = [r for r in got if r["component"] == k + 1]
        want = np.array([(np.array(by_id[r["vec_id"]]) - sums / n) @ axes[:, k] / math.sqrt(values[k]) for r in mine])
        have = np.array([r["whitened"] for r in mine])
        assert min(abs(have - want).max(), abs(have + want).max()) < 1e-9
        assert abs(mine[0]["explained"] - values[k] / values.sum()) < 1e-12
    assert all(r["n"] == n and r["deviation"] == int(((n * np.array(by_id[r["vec_id"]]) - sums) ** 2).sum()) and r["identity_error"] < 1e-9 for r in got)


def test_whitening_of_awkward_vectors(spark):
    ask = lambda rows: whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, vector array<bigint>"), "vec_id", "vector")
    assert ask([]).count() == ask([(1, [1, 2]), (2, [1, 2])]).count() == ask([(1, [])]).count() == 0
    flat = ask([(1, [1, 2]), (2, [3, 6]), (3, [2, 4])]).collect()  # one direction only
    assert {r["component"] for r in flat} == {1} and abs(flat[0]["explained"] - 1) < 1e-12
    with pytest.raises(ValueError, match="components"):
        ask([(1, [1]), (2, [1, 2])])


def test_components_without_numbers_drop_the_row(spark):
    rows = [(1, [1.0, 0.5]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [None, 1.0]), (5, None), (6, [-0.001, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    kept = df.filter(negatives.finite(df["embedding"])).select("vec_id", negatives.integers(df["embedding"])).collect()
    assert [tuple(r) for r in kept] == [(1, [256, 128]), (6, [-1, 0])]


# -- 13 quality --------------------------------------------------------------------------------------


def plain_base(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_base_counts_equal_plain_counts(spark):
    rng = random.Random(5)
    bits = ["one", "two", "Two", "#x", "é\U0001f600", "|", "a\x00b", "\xa0", "\x1c"]
    texts = ["".join(rng.choice(bits) + rng.choice([" ", "\n", "\t", "  ", "\n\n", " \r\n"]) for _ in range(rng.randrange(0, 140))) for _ in range(150)]
    texts += [None, "", " \n\t", "w " * 49 + "w", "\n".join(["same line here"] * 30), " ".join(f"w{i}" for i in range(60_000))]
    got = quality.judge(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, n_words string").repartition(3), "doc_id", "text", []).collect()
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain_base(texts[r["doc_id"]]), repr(texts[r["doc_id"]])[:200]
        assert r["kept"] == (not r["base_failed"])


def prose(rng, names, n):
    return " ".join(rng.choice(names) for _ in range(n))


def test_far_documents_fail_and_clean_ones_stay(spark):
    rng = random.Random(6)
    named = lambda lang, i: f"{lang}{i}".translate(str.maketrans("0123456789", "abcdefghij"))
    # forty common words make two in five
    tongues = {lang: [named(lang, i) for i in range(40)] * 50 + [named(lang, i) for i in range(1000, 4000)] for lang in ("u", "v")}
    rows = [(k, prose(rng, tongues[lang], 200), lang) for k, lang in enumerate(["u", "v"] * 40)]
    rows += [(100, prose(rng, tongues["u"], 100) + " " + prose(rng, tongues["v"], 100), None)]  # both languages
    rows += [(101, " ".join(f"{w}###$$$" for w in prose(rng, tongues["u"], 200).split()), "u"), (102, " ".join("q" + chr(97 + i % 26) + chr(97 + i // 26) for i in range(300)), "v"), (103, None, "u"), (104, "short", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    known = quality.references(df, "text", "lang")
    assert len(known) == 2 and all(abs(k.classes.sum() - 1) < 1e-12 and abs(k.words.sum() - 1) < 1e-12 for k in known)
    got = {r["doc_id"]: r for r in quality.judge(df, "doc_id", "text", known).collect()}
    assert all(got[k]["kept"] for k in range(80)) and got[100]["kept"]
    assert [got[k]["kept"] for k in (101, 102, 103, 104)] == [False] * 4
    assert got[101]["class_distance"] > quality.MOST_CLASS_DISTANCE and got[102]["word_distance"] > quality.MOST_WORD_DISTANCE
    assert got[104]["class_distance"] is None and got[104]["word_distance"] is None
    assert quality.judge(df.filter("false"), "doc_id", "text", quality.references(df.filter("false"), "text", "lang")).count() == 0


def test_distance_of_histograms():
    p = np.array([0.5, 0.5, 0.0])
    assert np.allclose(quality.js_distance(p, np.array([[0.5, 0.5, 0], [0, 0, 1]])), [0, 1])
    q = np.array([0.2, 0.3, 0.5])
    m = (p + q) / 2
    want = math.sqrt(sum(a * math.log2(a / b) for x in (p, q) for a, b in zip(x, m, strict=True) if a > 0) / 2)
    assert abs(quality.js_distance(p, q[None])[0] - want) < 1e-12


# -- 2, 3, 4, 7 and 10: mended -------------------------------------------------------------------------


def test_draws_have_unequal_probabilities(spark):
    rng = random.Random(8)
    rows = [(i, " ".join("w" * rng.choice([10, 40, 200, 1000])), "a" if i % 3 else "b") for i in range(300)]
    df = spark.createDataFrame([(i, t * 1, s) for i, t, s in rows], "doc_id bigint, text string, source string")
    sizes = {i: len(t.split()) for i, t, _ in rows}
    taken, runs = Counter(), 12
    for k in range(runs):
        got = mixing.mix(df, "doc_id", "text", "source", weights=(1, 3), share=0.6, seed=f"s{k}").collect()
        for s in "ab":
            mine = [r for r in got if r["source"] == s]
            assert abs(sum(r["size"] * r["copies"] for r in mine) - mine[0]["target"]) <= 1000
        taken.update({r["doc_id"]: r["copies"] for r in got})
    target = {r["source"]: (r["target"], r["source_size"]) for r in got}
    for s in "ab":
        mine = [i for i, _, x in rows if x == s]
        share, mean = target[s][0] / target[s][1], target[s][1] // len(mine)
        whole, share = int(share), share - int(share)
        lean = {i: 1024 * sizes[i] // (sizes[i] + mean) / 1024 for i in mine}
        middle = sum(sizes[i] * lean[i] for i in mine) / target[s][1]
        for size in (10, 40, 200, 1000):
            like = [i for i in mine if sizes[i] == size]
            want = whole + sum(share + min(share, 1 - share) * (middle - lean[i]) for i in like) / len(like)
            assert abs(sum(taken[i] for i in like) / runs / len(like) - want) < 0.09


def test_the_order_is_that_of_odds_ratios_not_of_the_random_numbers(spark):
    rows = [(i, " ".join(["w"] * (5 if i % 2 else 400)), "a") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r["doc_id"]: r["copies"] for r in mixing.mix(df, "doc_id", "text", "source", share=0.5).collect()}
    u = {r["doc_id"]: r["u"] for r in df.select("doc_id", mixing.unit_hash(df["doc_id"], seed=mixing.SEED).alias("u")).collect()}
    drawn = [u[i] for i in got if got[i]]
    left = [u[i] for i in got if not got[i]]
    assert sum(x > min(left) for x in drawn) > 10  # no prefix of the random numbers


def test_a_hot_id_is_learned(spark):
    names = [f"word{chr(97 + k)}" for k in range(20)]
    rng = random.Random(9)
    for doc_id in (7, 8, None):
        rows = [(doc_id, prose(rng, names, 8) + f" {i}", "en") for i in range(700)] + [(doc_id, "einmal ist keinmal", "de")] * 50
        langs, table = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), "doc_id", "text", "lang", most=100)
        assert langs == ["de", "en"]
        copies = langid.fit(spark.createDataFrame(rows * 3, "doc_id bigint, text string, lang string"), "doc_id", "text", "lang", most=100)
        assert copies[0] == langs and np.array_equal(copies[1], table)


def test_mixtures_equal_a_plain_em():
    rng = np.random.default_rng(12)
    likelihood = np.log(rng.dirichlet([0.3] * 3, 60)).astype(np.float32)
    got = langid.mixtures(likelihood, np.array([0, 25, 25, 60]))
    for (a, b), found in zip(((0, 25), (25, 60)), got[[0, 2]], strict=True):
        chance = np.exp(likelihood[a:b].astype(float))

        def em(part, steps):
            for _ in range(steps):
                joint = chance * part
                part = (joint / joint.sum(axis=1, keepdims=True)).mean(axis=0)
            return part, np.log((chance * part).sum(axis=1)).sum()

        part, score = em(np.full(3, 1 / 3), langid.FIRST_STEPS)
        while (part > 0).sum() > 1:
            trial = np.where(np.arange(3) == np.where(part > 0, part, 2).argmin(), 0, part)
            trial, fit = em(trial / trial.sum(), langid.MORE_STEPS)
            if 2 * (score - fit) >= math.log(b - a):
                break
            part, score = trial, fit
        assert np.allclose(found, part, atol=1e-3)
    assert not got[1].any()


def test_machine_does_not_depend_on_partitions_or_copies(spark):
    rng = random.Random(10)
    rows = [(i % 400, prose(rng, [f"t{k}" for k in range(60)], 20) + (" slur" if i % 4 == 0 else "")) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id bigint, toxic int")
    fit = lambda df: toxicity.fit(df, labels, "doc_id", "text", "toxic", F.col("doc_id") >= 0, most=300)
    first = fit(docs.repartition(3))
    for other in (fit(docs.repartition(7)), fit(docs.union(docs).repartition(5))):
        assert other.bias == first.bias and np.array_equal(other.weights, first.weights) and np.array_equal(other.factors, first.factors)


def test_scores_equal_the_sum_over_pairs():
    rng = np.random.default_rng(13)
    machine = toxicity.Machine(-0.3, rng.normal(0, 0.3, 50).astype(np.float32), rng.normal(0, 0.2, (50, toxicity.FACTORS)).astype(np.float32))
    rows = [np.sort(rng.choice(50, n, replace=False)) for n in (0, 1, 7, 30)]
    got = machine.scores(np.concatenate(rows), np.cumsum([0, *map(len, rows)]))
    for score, terms in zip(got, rows, strict=True):
        raw = machine.bias + machine.weights[terms].sum() + sum(machine.factors[a] @ machine.factors[b] for i, a in enumerate(terms) for b in terms[i + 1 :])
        assert abs(score - 1 / (1 + math.exp(-raw))) < 1e-5


def test_recall_of_near_duplicates(spark):
    """All links of similarity 0.8 among edited copies are in one component."""
    rng = random.Random(11)
    rows = []
    for g in range(60):
        base = prose(rng, [f"v{k}" for k in range(3000)], rng.randrange(40, 150)).split()
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, len(copy) // 22))):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text", n=2)
    component = {r["doc_id"]: r["component_id"] for r in found.collect()}
    sets = [{tuple(w[i : i + 2]) for i in range(len(w) - 1)} for w in (t.split() for _, t in rows)]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert len(links) > 100 and all(component[i] == component[j] for i, j in links)


#: What a browser shows, or the rules for articles keep.
PAGES = [
    ("<body><ul><li class=share>Share<li>One item</ul><p>The main text of the page goes on here.</p></body>", ["One item", "The main text of the page goes on here."]),
    ("<article><p title=it's>Hello world text</p><p>don't stop</p></article>", ["Hello world text", "don't stop"]),
    ("<article><p class='social history'>A</p><div id='reply-to-critics'>B</div><div class='share-bar'>C</div><p title=\"hidden gem\">D</p></article>", ["A", "B", "D"]),
    ("<head><title>x</title><meta a=b><p>para<table><tr><td class=ad>x<td>y<tr><td>z</table>tail", ["para", "y", "z", "tail"]),
    ("<p>a<div class=ad>no<p>no</div>b<dl><dt class=ad>n<dd>yes</dl>c", ["a", "b", "yes", "c"]),
    ("<div><p>one<a href=foo?x=\"a>two</a><p hidden>no<p>three</div>", ["onetwo", "three"]),
    ("<ul><li class=menu>no<ul><li>no</ul>no<li>yes</ul>", ["yes"]),
]


@pytest.mark.parametrize("html,want", PAGES)
def test_page_texts(html, want):
    assert extract.main_texts([html]) == ["\n\n".join(want)]


def test_short_repeats_inside_sentences_stay():
    pages = [f"<p>Page {k} says that all of our shops are open on day {k * k + 3}. Call us now for more help today. It was number {k}.</p>" for k in range(4)]
    assert extract.main_texts(pages) == [f"Page {k} says that all of our shops are open on day {k * k + 3}. It was number {k}." for k in range(4)]
