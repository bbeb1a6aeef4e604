import random

import numpy as np
import pytest

from pressmill.llm import op4_toxicity, op5_licenses, op7_html, op9_decontaminate
from tests.llm.util import awkward, prose


def _toxic_rows(n=400):
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(n):
        sentences = [prose(rng, 12).replace(".", "") for _ in range(8)]
        bad = k % 4 == 0
        if bad:
            sentences[rng.randrange(8)] += f" {rng.choice(['vilest', 'vilely', 'scornful'])} person {rng.choice(['vilest', 'scornful'])}"
        rows.append((k, ". ".join(sentences) + "."))
        labels.append((k, int(bad)))
    return rows, labels


def test_toxicity_learns_from_document_labels_and_finds_the_sentence(spark):
    rows, labels = _toxic_rows()
    rows += [(9001, None), (9002, ""), (None, "plain words"), (9003, "vilest scornful. " * 400)]
    docs = awkward(spark, rows)
    table = spark.createDataFrame([(d, t) for d, t in labels] + [(0, None), (None, 1)], "doc_id bigint, toxic int")
    model = op4_toxicity.train(docs, table)
    got = {r.doc_id: r for r in op4_toxicity.score(docs, model).collect()}
    unseen = {r.doc_id for r in docs.where(op4_toxicity.held_out(docs.doc_id)).collect()}
    truth = dict(labels)
    assert sum(got[d].predicted == truth[d] for d in unseen if d in truth) >= 0.97 * len([d for d in unseen if d in truth])
    assert got[9001].score == got[9002].score < 0.5 and got[9003].predicted == 1 and all(0 <= r.score <= 1 for r in got.values())
    found = op4_toxicity.offending_sentences(docs, model).where("doc_id < 400").collect()
    assert found and all("vil" in r.sentence or "scorn" in r.sentence for r in found)
    assert op4_toxicity.score(docs.where("false"), model).count() == 0
    none = op4_toxicity.train(docs, table.where("false"))
    assert max(r.score for r in op4_toxicity.score(docs, none).collect()) < 0.01


def test_scores_do_not_depend_on_other_columns(spark):
    rows, labels = _toxic_rows(80)
    model = op4_toxicity.fit([t for _, t in rows], [y for _, y in labels], (60, 20))
    a = sorted(r.score for r in op4_toxicity.score(awkward(spark, rows), model).collect())
    b = sorted(r.score for r in op4_toxicity.score(awkward(spark, [(d + 7, t) for d, t in rows]), model).collect())
    assert a == b


def test_licenses(spark):
    mit = op5_licenses.TEMPLATES["mit"]
    rows = [(1, f"text\n{mit}\nmore"), (2, None), (3, ""), (4, "a license plate in the town"), (5, "Licensed under the Apache License, Version 1.1."), (6, f"{mit}\n{mit}"), (7, "x" * 200_000 + " license"), (None, mit)]
    got = sorted(((r.doc_id or 0), r.block_no, r.template, r.exact, list(r.missing), list(r.added)) for r in op5_licenses.scan_licenses(awkward(spark, rows)).collect())
    assert got == [(0, 0, "mit", True, [], []), (1, 1, "mit", True, [], []), (5, 0, "apache-2.0", False, ["2.0"], ["1.1"]), (6, 0, "mit", True, [], []), (6, 1, "mit", True, [], [])]
    assert op5_licenses.scan_licenses(awkward(spark, [])).count() == 0
    for name, text in op5_licenses.TEMPLATES.items():
        assert op5_licenses.Scanner(op5_licenses.TEMPLATES).scan(text)[0] == name


def test_short_wrapped_and_embedded_licenses(spark):
    gpl = op5_licenses.TEMPLATES["gpl-3.0-header"].split()
    wrapped = "\n".join("# " + " ".join(gpl[k : k + 7]) for k in range(0, len(gpl), 7))
    rows = [
        (1, "All rights reserved."), (2, f"some text\n{wrapped}\nmore text"), (3, "Copyright 2020 Foo. Licensed under the Apache License, Version 2.0."), (4, "// SPDX-License-Identifier: GPL-3.0-or-later"),
        (5, "word " * 3000 + "Released under the MIT License. " + "word " * 3000), (6, "all rights\nreserved"), (7, "the free software of a public domain has no copyright here"), (8, "MIT License"),
    ]
    got = sorted((r.doc_id, r.block_no, r.template, r.exact, r.n_lines) for r in op5_licenses.scan_licenses(awkward(spark, rows)).collect())
    assert got == [
        (1, 0, "all-rights-reserved", True, 1), (2, 1, "gpl-3.0-header", True, len(wrapped.split("\n"))), (3, 0, "apache-2.0", True, 1), (4, 0, "spdx-gpl-3.0-or-later", True, 1),
        (5, 0, "mit", True, 1), (6, 0, "all-rights-reserved", True, 2),
    ]


def _exact(page, active, unary, pair):
    """Marginals by summing over all labellings."""
    from itertools import product

    n = len(page.tag)
    total, ones = 0.0, np.zeros(n)
    for labels in product((0, 1), repeat=n):
        e = sum(labels[k] * sum(unary[j] for j in active[k]) for k in range(n))
        e += sum(pair[op7_html._PAIR_AT[op7_html.KINDS[page.tag[k]]]][2 * labels[page.parent[k]] + labels[k]] for k in range(1, n))
        total += np.exp(e)
        ones += np.exp(e) * np.array(labels)
    return ones / total


def test_messages_give_exact_marginals():
    rng = np.random.default_rng(1)
    page = op7_html.Page("<body><nav><ul><li><a>x</a></li></ul></nav><article><h1>t</h1><p>some text. more</p><div class='ad'><p>buy</p></div></article></body>")
    unary, pair = rng.normal(size=len(op7_html.UNARY)).tolist(), rng.normal(size=(len(op7_html.PAIR_KINDS), 4)).tolist()
    active = page.unary()
    got, edges = op7_html.marginals(page, active, unary, pair)
    assert np.allclose(got, _exact(page, active, unary, pair)) and all(abs(sum(e) - 1) < 1e-9 for e in edges[1:])


def test_main_text(spark):
    head = "<html><head><title>T</title><style>p{}</style><script>var a='<p>no</p>';</script></head><body>"
    rows = [
        (1, "u", head + "<nav><ul><li><a href=/>Home page</a></li><li><a href=/>About us</a></li></ul></nav><!-- c --><div class='ad'>Buy this now.</div><article><h1>A   headline &amp; more</h1><p><b>First sentence of the long text that follows here.<br><p>Second &lt;b&gt; paragraph with\n enough words to be read. It ends.</p></article><div id=comments><p>I liked it very much, thanks.</p></div><footer>&copy; 2024 all of us</footer></body></html>"),
        (2, "u", None), (3, None, ""), (4, "u", "plain text only"), (5, "u", "<p>unclosed <b>bold"), (6, "u", "<div class='x"), (None, "u", "<<<>>>&&&;"), (7, "u", "<div>" * 3000 + "deep"),
    ]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, text int")
    got = {r.page_id: r for r in op7_html.extract(pages, op7_html.fitted()).collect()}
    assert got[1].text == "A headline & more\nFirst sentence of the long text that follows here.\nSecond <b> paragraph with enough words to be read. It ends."
    assert got[1].n_chars == len(got[1].text) and got[2].text == "" and got[3].n_chars == 0 and len(got) == 8
    assert op7_html.extract(pages.where("false"), ([0.0] * len(op7_html.UNARY), [[0.0] * 4] * len(op7_html.PAIR_KINDS))).count() == 0


def test_held_out_layouts():
    weights = op7_html.fitted()
    right = total = 0
    for seed in range(5000, 5060):
        html = op7_html.layout_page(seed)
        marked, plain = op7_html.Page(html), op7_html.Page(html.replace(" yes'", "'").replace(" no'", "'").replace("'yes'", "''").replace("'no'", "''"))
        m, _ = op7_html.marginals(plain, plain.unary(), *weights)
        for k, _ in plain.runs:
            right, total = right + ((m[k] > 0.5) == op7_html._marked_label(marked, k)), total + 1
    assert right >= 0.97 * total


def test_lcs_and_latent_space(spark):
    rng = random.Random(1)
    for _ in range(200):
        a, b = [rng.choice("abcd") for _ in range(rng.randint(0, 12))], [rng.choice("abcd") for _ in range(rng.randint(0, 15))]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert op9_decontaminate.lcs_length(a, b) == best[-1][-1]
    texts = [prose(rng, 30) for _ in range(12)]
    vocabulary = {}
    for t in texts:
        for w in op9_decontaminate.words(t):
            vocabulary.setdefault(w, len(vocabulary))
    idf = np.ones(len(vocabulary))
    basis = op9_decontaminate.latent_basis(spark.createDataFrame([(t,) for t in texts], "text string"), vocabulary, idf, rank=12)
    a = np.zeros((12, len(vocabulary)))
    for k, t in enumerate(texts):
        at, weight = op9_decontaminate.tf_idf(np.array([vocabulary[w] for w in op9_decontaminate.words(t)]), idf)
        a[k, at] = weight
    assert np.allclose(np.linalg.norm(a @ basis, axis=1), 1, atol=1e-4)  # full rank: nothing of the items is lost
    exact = np.linalg.svd(a, compute_uv=False)
    short = op9_decontaminate.latent_basis(spark.createDataFrame([(t,) for t in texts], "text string"), vocabulary, idf, rank=4)
    assert np.allclose(np.linalg.svd(a @ short, compute_uv=False)[:4], exact[:4], rtol=0.02)


def test_leaks_are_found_and_clean_documents_left_alone(spark):
    rng = random.Random(6)
    items = [(k, prose(rng, rng.randint(16, 60)).capitalize() + ".") for k in range(30)] + [(90, None), (91, "")]
    rows, want = [], set()
    for k in range(120):
        words = prose(rng, rng.randint(20, 700)).split()
        if k % 3 == 0:
            item = rng.randrange(30)
            own = items[item][1].split()
            if k % 2:
                own[len(own) // 3] = "altered"  # a paraphrase of one word
            at = rng.randrange(len(words))
            words[at:at] = own
            want.add((k, item))
        rows.append((k, " ".join(words)))
    rows += [(500, None), (501, ""), (0, rows[0][1])]
    benchmark = spark.createDataFrame([(*x, 3) for x in items], "item_id bigint, text string, doc_id int")
    got = {(r.doc_id, r.item_id) for r in op9_decontaminate.contaminated(awkward(spark, rows), benchmark).collect()}
    assert want <= got and len(got - want) == 0
    assert op9_decontaminate.contaminated(awkward(spark, []), benchmark).count() == 0
    assert op9_decontaminate.contaminated(awkward(spark, rows), benchmark.where("false")).count() == 0
    spread = op9_decontaminate.contaminated(awkward(spark, rows), benchmark.repartition(70)).collect()  # with empty partitions
    assert {(r.doc_id, r.item_id) for r in spread} == got


def test_leaks_with_reworded_or_missing_answers(spark):
    rng = random.Random(16)
    items = [(k, f"{prose(rng, 40).replace('.', '')}. answer{k}.") for k in range(20)]
    rows = []
    for k, text in items:
        own, around = text.split(), prose(rng, 300).split()
        reworded = [w if rng.random() > 0.1 else f"other{j}" for j, w in enumerate(own[:-1])]
        rows.append((2 * k, " ".join([*around[:90], *own[:-1], *around[90:]])))  # without its last sentence
        rows.append((2 * k + 1, " ".join([*around[:90], *reworded, "changed", *around[90:]])))
    want = {(2 * k, k) for k, _ in items} | {(2 * k + 1, k) for k, _ in items if op9_decontaminate.lcs_length(op9_decontaminate.words(items[k][1]), op9_decontaminate.words(rows[2 * k + 1][1])) >= 0.8 * len(op9_decontaminate.words(items[k][1]))}
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in op9_decontaminate.contaminated(awkward(spark, rows), benchmark).collect()}
    assert len(want) > 30 and want <= got
    assert op9_decontaminate.answer_words("a b c d. e f! \u00d1.") == {"e", "f", "\u00f1"}


def test_markup_is_read_in_linear_time_and_loses_no_text():
    import time

    for html in ("<a" * 500_000, '<a "' * 250_000, "<a '\"" * 200_000, "<!" * 500_000, "<svg>" * 200_000, "<option>a" * 100_000, "</a" * 300_000, "<script>" * 100_000, "<div>" * 100_000 + "</p>" * 100_000):
        t = time.time()
        op7_html.Page(html)
        assert time.time() - t < 15, html[:20]
    text = lambda html: [t for _, t in op7_html.Page(html).runs]
    assert text("<article><p>a<svg width='1'/> b</p><p>c</p></article>") == ["a b", "c"]
    assert text("<article><p>a <video> b</p><p>c</p></article>") == ["a b", "c"]
    assert text("<article><p>a<option>x</p><p>c</p></article>") == ["ax", "c"]
    assert text("<p>a<svg><text>no</text></svg>b</p><p>a < b <3</p><script>x") == ["ab", "a < b <3"]
    assert text('<p title="1 > 0" class=\'x"y\'>kept</p>') == ["kept"]


@pytest.mark.parametrize(("least", "most"), [(5, 8), (9, 14), (20, 50), (120, 200)])
def test_recall_of_reworded_items_by_length(least, most):
    """Every planted item that meets the LCS and answer rules should be a candidate, whatever its length."""
    import random

    import numpy as np

    rng = random.Random(least)
    pool = [prose(rng, 700).replace(",", "").replace(".", "").split() for _ in range(40)]
    items = []
    for k in range(80):
        w = rng.choice(pool)
        n = rng.randint(least, most)
        at = rng.randrange(len(w) - n)
        items.append((k, " ".join(f"{x}{rng.randrange(30)}" for x in w[at : at + n])))
    vocabulary = {}
    for _, t in items:
        for w in op9_decontaminate.words(t):
            vocabulary.setdefault(w, len(vocabulary))
    idf = np.full(len(vocabulary), 3.0)
    a = np.zeros((len(items), len(vocabulary)))
    for k, t in items:
        at, weight = op9_decontaminate.tf_idf(np.array([vocabulary[w] for w in op9_decontaminate.words(t)]), idf)
        a[k, at] = weight
    basis = np.linalg.svd(a, full_matrices=False)[2][: op9_decontaminate.RANK].T.astype(np.float32)
    s = op9_decontaminate.Searcher(vocabulary, idf, basis, items)
    found = wanted = 0
    for k, t in items:
        w = t.split()
        for share in (0.0, 0.1, 0.2, 0.3):
            v = [x if rng.random() >= share else "else" for x in w]
            lcs, told = op9_decontaminate.lcs_length(w, v) / len(w), len(s.answers[k] & set(v)) / len(s.answers[k])
            if lcs >= op9_decontaminate.SURE or lcs >= op9_decontaminate.LCS and told >= op9_decontaminate.ANSWER:
                host = rng.choice(pool)
                wanted += 1
                found += any(h[0] == k for h in s.search(" ".join(host[:150] + v + host[150:300])))
    assert wanted > 150 and found >= 0.95 * wanted


@pytest.mark.parametrize(
    ("html", "runs"),
    [
        ("<p>a<svg><svg></svg><text>no</text></svg>b</p>", ["ab"]),
        ("<p>x<noscript>no<noscript>no</noscript>no</noscript>y", ["xy"]),
        ("<p>a<select><option>no</option><select></select></select>b", ["a b"]),
        ("<p>a<button>no<button>no</button>no</button>b", ["a b"]),
        ("<p>a<svg><!-- </svg> -->no</svg>b", ["ab"]),
        ("<p>a<svg/>b<svg>no</svg>c", ["abc"]),
        ("<p>a<svg>open<svg>no</svg>c", ["aopenc"]),
        ("<p>a</svg>b", ["ab"]),
        ("<svg>" * 3000 + "<p>still there", ["still there"]),
    ],
)
def test_op7_hidden_elements_nest(html, runs):
    assert [text for _, text in op7_html.Page(html).runs] == runs


def test_op9_words_must_stand_near_one_another():
    """Only stretches in which enough of an item's words are close together are compared; none with a match is left out."""
    names = [f"w{k}" for k in range(40)]
    vocabulary = {w: k for k, w in enumerate(names)}
    items = [(1, " ".join(names[:20])), (2, " ".join([*names[20:30], *["w39"] * 4])), (3, " ".join(names[10:35]))]
    searcher = op9_decontaminate.Searcher(vocabulary, np.ones(40), np.eye(40, dtype=np.float32), items)
    ids = lambda words: np.array([vocabulary.get(w, -1) for w in words], np.int64)
    spread = [w for k in range(20) for w in (names[k], *["other"] * 20)]
    assert not searcher.possible(ids(spread)).any()
    assert searcher.possible(ids(["other"] * 50 + names[:12] + ["other"] * 50)).tolist() == [True, False, False]
    # A word counts no more often than the item has it.
    assert not searcher.possible(ids(["w39"] * 60 + names[20:24] + ["w39"] * 60)).any()
    assert searcher.possible(ids(names[20:25] + ["w39"] * 60)).tolist() == [False, True, False]

    random_ = random.Random(5)
    for _ in range(300):
        text = ids([random_.choice([*names, "other"]) for _ in range(random_.randrange(1, 300))])
        found = []
        for counts, reach, least in zip(searcher.counts, searcher.reach, searcher.least, strict=True):
            parts = [text[a : a + reach].tolist() for a in range(len(text))]
            found.append(max(sum(min(part.count(w), n) for w, n in counts.items()) for part in parts) >= least)
        assert searcher.possible(text).tolist() == found
