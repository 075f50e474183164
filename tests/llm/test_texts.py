"""Language, toxicity, benchmark leaks, web pages."""

import itertools
import math
import os
import random
import re
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from ward_analytics.llm import arrays, decontaminate, html_text, langid, tables, toxicity

PIECES = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = {
    "en": "the cat and the dog went to the house of their friend with some bread which was good",
    "de": "der hund und die katze gehen nicht in das haus weil der weg zu weit ist und es regnet",
    "fr": "le chat et le chien sont dans la maison avec une amie qui mange du pain pour le soir",
}


def labelled(spark):
    rows = [(10 * i + k, " ".join(random.Random(i).sample(t.split(), 9)), lang) for i in range(12) for k, (lang, t) in enumerate(TEXTS.items())]
    return spark.createDataFrame([*rows, (1, None, "en"), (2, "junk", None), (3, "", "de")], "doc_id long, text string, lang string")


def test_languages(workers, frame):
    languages, chance = langid.learn(labelled(workers), PIECES)
    assert languages == ["de", "en", "fr"]
    assert np.allclose(chance.sum(axis=0), 1)
    rows = [(1, "THE friend of the cat!"), (2, "die katze und das haus"), (3, "la maison avec le pain"), (4, None), (5, ""), (6, "12 #?!"), (None, "the dog"), (1, "the dog"), (7, "x" * 500), (8, "привет")]
    found = langid.identify(frame(rows), languages, chance, PIECES, ["doc_id", "chunk"]).collect()
    got = sorted((r.doc_id or 0, r.lang_pred) for r in found)
    assert got[:7] == [(0, "en"), (1, "en"), (1, "en"), (2, "de"), (3, "fr"), (4, "und"), (5, "und")] and got[7] == (6, "und")
    assert all(0 <= r.score <= 1 and (r.lang_pred != "und" or r.score == 0) for r in found)
    nats = {r.doc_id: r.nats_a_letter for r in found}
    assert nats[8] > max(nats[1], nats[2], nats[3])


def test_without_labels_every_text_is_und(workers, frame):
    languages, chance = langid.learn(labelled(workers).where("doc_id < 0"), PIECES)
    found = langid.identify(frame([(1, "the cat")]), languages, chance, PIECES, ["doc_id"]).collect()
    assert [(r.lang_pred, r.score) for r in found] == [("und", 0.0)]
    assert langid.identify(frame([(1, "x")]).where("doc_id < 0"), ["en"], chance, PIECES, ["doc_id"]).collect() == []


def segmentations(word, pieces):
    if not word:
        yield ()
    for n in range(1, len(word) + 1):
        if word[:n] in pieces:
            for rest in segmentations(word[n:], pieces):
                yield (word[:n], *rest)


def lattice(*words, opens=True):
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return langid.Lattice(data, ends - [len(w) for w in words], ends, np.full(len(words), opens), PIECES)


def test_likelihood_sums_all_segmentations():
    pieces = {p: i for i, p in enumerate(langid.vocabulary(PIECES))}
    chance = np.random.RandomState(0).dirichlet(np.ones(len(pieces)) * 0.1, 5).T + 1e-6
    lifted = langid.lifted(chance, PIECES)
    for opens, text in itertools.product((True, False), ("house", "été", "q", "schaftlich")):
        word = (b" " if opens else b"") + text.encode()
        ways = [[pieces[p] for p in way] for way in segmentations(word, pieces)]
        found = lattice(text.encode(), opens=opens)
        assert np.allclose(np.exp(found.log_likelihood(lifted)[0]), sum(np.prod(chance[way], axis=0) for way in ways))
        _, times, likelihood = found.expected(lifted, np.array([1]), np.array([2.0]))
        weights = [np.prod(chance[way, 1]) for way in ways]
        assert math.isclose(times.sum(), 2 * np.dot(weights, [len(way) for way in ways]) / sum(weights))
        assert math.isclose(likelihood, 2 * math.log(sum(weights)))


def test_every_piece_of_the_vocabulary_is_found():
    pieces = langid.vocabulary(PIECES)
    for opens in (True, False):
        mine = [(i, p[1:] if opens else p) for i, p in enumerate(pieces) if p.startswith(b" ") == opens and len(p) > opens]
        found = lattice(*(p for _, p in mine), opens=opens)
        whole = {}
        for end, words, which in found.edges[0]:
            whole.update({int(w): int(k) for w, k in zip(words, which, strict=True) if found.size[w] == end})
        assert [whole[k] for k in np.argsort(found.order)] == [i for i, _ in mine]


def test_long_runs_are_cut_between_characters():
    text = "é" * 40 + " " + "日本語" * 30 + " " + "x" * 130 + " ab"
    (_, _, part, starts, ends, _, opens) = next(langid.letter_words(pa.array([text])))
    parts = [part[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
    assert max(len(p.encode()) for p in parts) <= langid.WORD_BYTES and "".join(parts) == text.replace(" ", "")
    assert [i for i, o in enumerate(opens) if o] == [0, 2, parts.index("x" * 45), len(parts) - 1]
    assert np.isfinite(lattice(b"\xff" * 48).log_likelihood(langid.lifted(np.full((len(langid.vocabulary(PIECES)), 2), 1e-8), PIECES))).all()


def test_learning_settles_and_counts_all_words(workers):
    words = langid.count_words(labelled(workers).where("lang is not null and text is not null"), ["de", "en", "fr"])
    times = {(r.word, r.language): r.times for r in words.collect()}
    whole = sum(len(x.split()) for r in labelled(workers).where("lang is not null").collect() for x in [r.text or ""])
    assert sum(times.values()) == whole
    once, often = (langid.learn(labelled(workers), PIECES, rounds)[1] for rounds in (1, langid.ROUNDS))
    assert np.abs(once - often).max() > 0 and np.allclose(often.sum(axis=0), 1)


def toxic_rows(spark, n=300):
    rng = random.Random(4)
    plain = ["tree", "river", "stone", "cloud", "bread", "night", "music", "garden", "window", "paper"]
    rows, labels = [], []
    for d in range(n):
        words = rng.choices(plain, k=rng.choice([5, 20, 60]))
        toxic = d % 4 == 0
        for _ in range(2 + len(words) // 10 if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(["gnarfy", "gnarlish", "Gnarple"])
        rows.append((d, " ".join(words)))
        labels.append((d, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (5, None), (None, 1), (0, 0)], "doc_id long, toxic int")


def test_toxicity_of_held_out_documents(workers, frame):
    documents, labels = toxic_rows(workers)
    model = toxicity.fit(documents, labels)
    found = toxicity.score(documents.withColumn("held_out", tables.held_out()), model, ["doc_id", "held_out"]).where("held_out").collect()
    assert len(found) > 30 and all((r.doc_id % 4 == 0) == (r.predicted == 1) == (r.score >= 0.5) for r in found)
    odd = toxicity.score(frame([(1, None), (2, ""), (2, "gnarf " * 500), (None, "tree")]), model, ["doc_id"]).collect()
    assert sorted((r.doc_id or 0, r.predicted) for r in odd) == [(0, 0), (1, 0), (2, 0), (2, 1)]


def test_toxicity_without_labels(workers, frame):
    documents, labels = toxic_rows(workers, 20)
    model = toxicity.fit(documents, labels.where("doc_id < 0"))
    assert [r.score < 0.01 for r in toxicity.score(frame([(1, "x")]), model, ["doc_id"]).collect()] == [True]


def test_grams_know_their_suffix_and_history():
    texts = pa.array(["aab aac abb", "aab ccc", "abc abc abd"])
    grams, ordinary, toxics = (np.concatenate(x) for x in zip(*toxicity.count_words(texts, np.array([0, 1, 1])), strict=True))
    names, where = np.unique(grams, return_inverse=True)
    model = toxicity.build(names, np.stack([np.bincount(where, x) for x in (ordinary, toxics)], axis=1))
    word = np.frombuffer(b"aabzz", np.uint8)
    gap = model.word_gaps(word, np.array([0, 0]), np.array([3, 5]))
    assert np.isfinite(gap).all()
    seen = toxicity._grams(np.frombuffer(b" aab", np.uint8), 4)[-1:]
    assert toxicity._suffix(seen)[0] == toxicity._grams(np.frombuffer(b"aab", np.uint8), 3)[-1]
    assert toxicity._history(seen)[0] == toxicity._grams(np.frombuffer(b" aa", np.uint8), 3)[-1]


ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen"


def test_leaks(workers, frame):
    words = ITEM.split()
    swapped = [w if i % 5 != 2 else "other" for i, w in enumerate(words)]
    rows = [
        (1, f"intro text {ITEM} end"), (2, "a b " + " ".join(swapped)), (3, "one two three four nothing else here at all"), (4, None), (5, ""),
        (6, ITEM.upper().replace(" ", "!! ")), (7, " ".join(words[:12]) + " and then something else"), (None, ITEM), (1, ITEM), (8, " ".join(words[::-1])),
        (9, f"{' '.join(words[:8])} x {ITEM}"),
    ]
    items = workers.createDataFrame([(100, ITEM), (101, "too short"), (102, None), (None, "alpha beta gamma delta epsilon zeta eta theta")], "item_id long, text string")
    found = decontaminate.find_leaks(frame(rows), items).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in found) == [(0, 100), (1, 100), (1, 100), (2, 100), (6, 100), (7, 100), (9, 100)]
    by = {r.doc_id: r for r in found}
    assert (by[9].doc_start, by[9].n_words, by[9].n_matches, by[9].similarity) == (9, 18, 18, 1.0)
    assert by[7].n_matches == 12 and by[2].n_matches == 14
    kept = decontaminate.drop_leaking(frame(rows), items)
    assert kept.columns == ["doc_id", "text", "chunk", "n_words", "score"]
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [3, 4, 5, 8]  # the leaking row without an id goes, too
    shared = decontaminate.drop_leaking(frame([(1, ITEM), (1, "clean"), (None, "clean"), (None, ITEM), (2, None)]), items)
    assert sorted((r.doc_id or 0, r.text or "") for r in shared.collect()) == [(0, "clean"), (1, "clean"), (2, "")]


def test_leaks_of_nothing(workers, frame):
    items = workers.createDataFrame([(100, ITEM)], "item_id long, text string")
    assert decontaminate.find_leaks(frame([(1, ITEM)]).where("doc_id < 0"), items).collect() == []
    assert decontaminate.find_leaks(frame([(1, ITEM)]), items.where("item_id < 0")).collect() == []
    assert decontaminate.drop_leaking(frame([(1, ITEM)]).where("doc_id < 0"), items).collect() == []
    assert [r.doc_id for r in decontaminate.drop_leaking(frame([(1, ITEM)]), items.where("item_id < 0")).collect()] == [1]


def test_several_blocks_of_items_drop_what_one_does(workers, frame, monkeypatch):
    items = workers.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(20))) for i in range(6)], "item_id long, text string")
    rows = [(i, f"before {r.text} after" if i % 2 else "nothing here") for i, r in enumerate(items.collect())]
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 40)
    assert sorted(r.doc_id for r in decontaminate.drop_leaking(frame(rows), items).collect()) == [0, 2, 4]


def test_a_leak_is_the_best_stretch_that_is_alike_enough(workers, frame):
    words = [f"w{i}" for i in range(60)]
    loose = words[:12] + [w if i % 5 in (0, 2, 4) else "x" for i, w in enumerate(words[12:42])]
    fourth, third = ([w if i % n != 1 else "x" for i, w in enumerate(words)] for n in (4, 3))
    rows = [(1, " ".join(loose)), (2, " ".join(["y", *fourth])), (3, " ".join(third)), (4, " ".join(words[:12] + ["x"] * 30 + words[42:52]))]
    items = workers.createDataFrame([(100, " ".join(words))], "item_id long, text string")
    found = {r.doc_id: r for r in decontaminate.find_leaks(frame(rows), items).collect()}
    assert sorted(found) == [1, 2, 4]
    for d, text in rows:
        equal = [a == b for a, b in zip(text.split()[d == 2 :], words, strict=False)]
        stretches = [(-sum(equal[i:j]), i, j - i) for i in range(len(equal)) for j in range(i + 1, len(equal) + 1) if 4 * sum(equal[i:j]) >= 3 * (j - i)]
        best = [s for s in stretches if s[0] == min(stretches)[0]]
        if d in found:
            r = found[d]
            ends = equal[r.item_start], equal[r.item_start + r.n_words - 1]
            assert all(ends) and r.doc_start - r.item_start == (d == 2) and (-r.n_matches, r.item_start, r.n_words) in best
        else:
            assert all(-n < 10 for n, _, _ in best)


@pytest.mark.parametrize("every", [3, 4, 5, 6])
def test_masks_survive_regular_substitutions(every):
    words = [f"w{i}" for i in range(40)]
    index = decontaminate.Index([1], [" ".join(words)])
    for phase in range(every):
        text = pa.array([" ".join("x" if i % every == phase else w for i, w in enumerate(words))])
        data, offsets = arrays.text_bytes(text)
        starts, ends, first = arrays.spans(data, offsets)
        assert len(index.line_ups(arrays.names(data, starts, ends), first)[0])


def test_masks_survive_any_substitutions_that_leave_a_leak():
    """A longer stretch has a part of 14 to 27 words that is a leak by itself."""
    for n in range(10, 28):
        for gone in range(n - 9):
            if n - gone < decontaminate.LEAST_SHARE * n:
                break
            places = np.array(list(itertools.combinations(range(1, n - 1), gone)), np.int64).reshape(-1, gone) if gone else np.zeros((1, 0), np.int64)
            kept = (1 << n) - 1 - (1 << places).sum(axis=1)
            met = np.zeros(len(kept), bool)
            for mask in decontaminate.MASKS:
                bits = int(mask, 2)
                for shift in range(n - len(mask) + 1):
                    met |= kept & (bits << shift) == bits << shift
            assert met.all(), (n, gone)


def test_leaks_with_random_substitutions(workers, frame):
    rng, rows, items = random.Random(7), [], []
    for d in range(300):
        n = rng.randrange(13, 31)
        words, gone = [f"w{d}x{i}" for i in range(n)], set(rng.sample(range(1, n - 1), n // 4))
        items.append((d, " ".join(words)))
        rows.append((d, " ".join(["a", "b", *("x" if i in gone else w for i, w in enumerate(words)), "c"])))
    found = decontaminate.find_leaks(frame(rows), workers.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(d, d) for d in range(300)]
    assert all((r.doc_start, r.item_start, r.n_matches) == (2, 0, sum(w != "x" for w in rows[r.doc_id][1].split()) - 3) for r in found)


PAGE = """<html><head><title>T</title></head><body class="has-sidebar"><header><h1>Site</h1><p>Welcome to the site of the best people
in the whole of the world.</p></header><div class="cookie-notice">We use cookies &amp; more</div><main><div class="breadcrumbs"><a href=/>Home</a></div>
<article class="post"><header class="article-header"><h1>Real Title</h1><p class=byline>By Bob</p></header><p>First para with <a href="x">a link</a>
&amp; more&nbsp;text.</p><script>var t="</p>";</script><ul><li>One</li><li>Two</li></ul><div class="ad-slot">Buy now</div><aside>Side</aside>
<p>Second<br>line</p><form><input><label>Name</label></form><div class="share">Share this</div><p hidden>Gone</p><!-- no --><p>Caf&eacute; &#x41;</p>
</article><section id="comments"><article class="comment"><p>I like the article of the man in the house.</p></article></section></main><footer>foot</footer>"""
LONG = "The cat sat on the mat and it was a good day for all of the cats in the house, which was big and in the middle of the town, and that was that for the day of the year and the rest of it was of no matter to the cat or to the dog."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (PAGE, "Real Title\nFirst para with a link & more text.\nOne\nTwo\nSecond line\nCafé A"),
        (f"<body><div id=nav><a href=a>Home</a> <a href=b>About</a></div><h2>Heading</h2><p>{LONG}<p>Yes.</p><p>{LONG}</p><p>Zzz</p><div><a href=1>One</a> <a href=2>two</a></div>", f"Heading\n{LONG}\nYes.\n{LONG}"),
        ("<p>Hello world.", "Hello world."), ("<article><p>cut &am", "cut &am"), ("", ""), (None, ""), ("<script>x", ""), ("<article><p>a</p><p>b < c</p></article>", "a\nb < c"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_pages(workers):
    rows = [(1, "u", "<article><p>Some text é</p></article>", "x"), (1, None, None, "x"), (None, "v", "<p>" + "of the word " * 20_000, "x")]
    pages = workers.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = {(r.page_id, r.url): (r.text, r.n_chars) for r in html_text.extract(pages).collect()}
    assert found[1, "u"] == ("Some text é", 11) and found[1, None] == ("", 0) and found[None, "v"][1] == 239_999
    assert html_text.extract(pages.where("page_id > 5")).collect() == []
    assert len(list(itertools.chain(html_text.blocks(PAGE)))) > 5


STORY = "The house was old and it had been empty for many years, but the people of the village said that there was a light in it. " * 3


def plain_label(size, linked, stops, article):
    """The first pass by the rules as written down."""
    if linked > (0.5 if article else 0.33):
        return False
    if article:
        return True if size >= 25 else None
    if size < 70:
        return False if linked else None
    if stops >= 0.2:
        return True if size > 200 else None
    return None if stops >= 0.12 or linked == 0 else False


def plain_classify(found):
    """Both passes, block by block, with a look at all other blocks for the neighbours."""
    share = lambda b: len(" ".join("".join(b.links).split())) / len(b.text)
    labels = [plain_label(len(b.text), share(b), html_text.stop_density(b.text), b.article) for b in found]
    if True not in labels:
        labels = [True if x is None and share(b) == 0 and len(b.text) > 200 else x for b, x in zip(found, labels)]
    inside = sum(len(b.text) for b, x in zip(found, labels) if b.article and x is not False)
    if any(b.article for b in found) and inside >= sum(len(b.text) for b, x in zip(found, labels) if not b.article and x):
        labels, found = [x for b, x in zip(found, labels) if b.article], [b for b in found if b.article]
    out = []
    for i, (b, label) in enumerate(zip(found, labels)):
        behind = [j for j in range(i) if labels[j] is not None]
        ahead = [j for j in range(i + 1, len(found)) if labels[j] is not None]
        if label is None:
            near = [*behind[-1:], *ahead[:1]]
            if len(near) < 2:
                label = labels[near[0]] if near else True
            elif labels[near[0]] == labels[near[1]]:
                label = labels[near[0]]
            elif b.article or html_text.stop_density(b.text) >= 0.2:
                label = True
            else:
                label = labels[near[0]] if i - near[0] < near[1] - i else labels[near[1]] if near[1] - i < i - near[0] else False
        if label:
            out.append(b.text)
    return out


def test_passes_equal_a_plain_version():
    rng = random.Random(11)
    kinds = [STORY, "Short one.", "Menu", "numbers 12 34 56 words without any stops " * 6, "the cat and the dog in the house " * 3, "x" * 90]
    for _ in range(400):
        parts = []
        for _ in range(rng.randint(1, 9)):
            text = rng.choice(kinds)
            if rng.random() < 0.4:
                at = rng.randint(0, len(text))
                text = f"{text[:at]}<a href=x>{text[at:]}</a>"
            parts.append(f"<article><p>{text}</p></article>" if rng.random() < 0.2 else f"<div>{text}</div>")
        page = "".join(parts)
        found = html_text.blocks(page)
        assert [b.text for b in html_text.classify(html_text.blocks(page))] == plain_classify(found)


def test_a_teaser_in_an_article_does_not_hide_the_story():
    page = f"<body><nav><a href=x>Home</a></nav><div><p>{STORY}</p><p>{STORY}</p></div><article><p>Read this too, it is a good one.</p></article></body>"
    assert html_text.main_text(page).count(STORY.strip()) == 2
    assert html_text.main_text(f"<article><p>{STORY}</p></article><div>All rights are with the owner of the site.</div>") == STORY.strip()


def test_names_inside_an_article_do_not_empty_it():
    for name in ("ad-hoc", "social", "comment"):
        assert html_text.main_text(f'<article><div class="{name}"><p>{STORY}</p></div></article>') == STORY.strip()
    assert html_text.main_text(f'<article><p>{STORY}</p><div class="social">Share it with all of your friends.</div></article>') == STORY.strip()
    assert html_text.main_text('<div class="ad">Buy it now, it is good for you.</div>') == ""


def test_languages_without_known_stop_words():
    italian = "Il gatto nero dormiva sopra il tetto della casa mentre pioveva forte e nessuno degli abitanti riusciva a vederlo. " * 3
    japanese = "昔々あるところにおじいさんとおばあさんが住んでいました。" * 12
    for story in (italian, japanese):
        page = f"<ul><li><a href=x>Uno</a><li><a href=y>Due</a></ul><div><p>{story}</p><p>{story}</p></div><div><a href=z>{'altro ' * 20}</a></div>"
        assert html_text.main_text(page) == f"{story.strip()}\n{story.strip()}"


@pytest.mark.parametrize("probe", [
    "<a " * 100_000 + '"', "<div>" * 60_000 + "</p>" * 60_000, "<b>" * 50_000 + "<hr>" * 50_000, "<script " * 60_000, "<a '" * 100_000 + '"',
    "<b>" * 50_000 + "</i>" * 50_000, "<i><div>" * 40_000 + "</i>" * 40_000, "&amp;" * 200_000, "<!-- " * 100_000, "<p>" + "a " * 500_000,
])
def test_long_pages_of_odd_markup_take_seconds(probe):
    began = time.process_time()
    html_text.main_text(probe)
    assert time.process_time() - began < 15


@pytest.mark.skipif(not os.path.isfile("/root/testdata/sf0.01/pages.parquet"), reason="no test tables")
def test_pages_read_the_same_without_the_mark_of_the_article():
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column(0).to_pylist():
        assert html_text.main_text(re.sub("</?article[^>]*>", "", page or "")) == html_text.main_text(page)
