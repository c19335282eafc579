"""The corpus operators on small fixtures: brute force, round trips and odd inputs."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lutework.llm import chat, decontam, htmlcrf, licenses, linededup, mixing, nearcopies, quality, simhash, tokens, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, __size string, fp string, probability double"


def docs(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["s"] * len(texts))[i], len(t or ""), "x", "y", 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(r, n, size=400):
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


ODD = [None, "", "   \n\t ", "one", "x" * 50_000, "a b c " * 3000, "tie tie", "tie tie", "\n".join(["same line of five words"] * 40), "é ü 漢字 😀 \x1c y"]


@pytest.fixture(scope="module")
def odd(spark):
    frame = docs(spark, ODD, [None, "a", "b", None, "a", "c", "c", "c", "a", "b"])
    return frame.unionByName(frame.limit(3)).unionByName(spark.createDataFrame([(None, "no id here", None, None, None, None, None, None)], DOCS))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# 1


def plain_mix(rows, share=1.5, cap=2.0, weights=(3, 1, 2)):
    """Water is filled by resharing the excess again and again."""
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, target, free = share * sum(sizes.values()), {}, set(names)
    while free:
        total = sum(w[s] for s in free)
        full = {s for s in free if left * w[s] / total >= cap * sizes[s]}
        if not full:
            target |= {s: left * w[s] / total for s in free}
            break
        for s in full:
            target[s] = cap * sizes[s]
        left -= sum(cap * sizes[s] for s in full)
        free -= full
    return sizes, target


def test_mix_targets_and_limits(spark):
    r = random.Random(1)
    frame = docs(spark, [prose(r, r.randrange(1, 60)) for _ in range(300)], [r.choice(["a", "b", "c", "d", None]) for _ in range(300)])
    got = mixing.mix_report(frame).collect()
    again = mixing.mix_report(frame.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    given = frame.select("doc_id", "source", "text").collect()
    sizes, target = plain_mix([(x["doc_id"], x["source"], len(x["text"].split())) for x in given])
    source = {x["doc_id"]: x["source"] for x in given}
    taken = {}
    for x in got:
        s = source[x["doc_id"]]
        assert x["source_size"] == sizes[s] and abs(x["target"] - target[s]) < 1e-6
        assert 0 <= x["taken"] <= 2 * x["size"]
        taken[s] = taken.get(s, 0) + x["taken"]
    for s, n in taken.items():
        assert abs(n - target[s]) <= 60
    copies = {x["doc_id"]: x["n"] for x in mixing.mix_documents(frame).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert all(copies.get(x["doc_id"], 0) * x["size"] == x["taken"] for x in got)


def test_mix_odd(odd, none):
    got = mixing.mix_report(odd).collect()
    assert len(got) == odd.count() and all(0 <= x["taken"] <= 2 * x["size"] for x in got)
    assert mixing.mix_documents(odd).columns == odd.columns
    assert mixing.mix_report(none).count() == 0 and mixing.mix_documents(none).count() == 0


# 2


def plain_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = {}
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(odd, none, spark):
    r = random.Random(2)
    part = prose(r, 30)
    frame = odd.unionByName(docs(spark, [f"{part} {prose(r, 9)} {part}", prose(r, 7), "Home | About | News | Contact\n" + prose(r, 40), "### $$$ %%% &&&\n" * 30]))
    got = quality.measured(frame).collect()
    for x in got:
        assert tuple(x[m] for m in quality.MEASURES[:5]) == plain_quality(x["row"]["text"])
        assert x["base_failed"] == (x["n_words"] < 20 or 100 * x["n_repeat_words"] > 30 * x["n_words"])
        assert not (x["base_failed"] and x["kept"])
    cleaned = quality.cleaned(frame).collect()
    assert cleaned and all("Home | About" not in x["text"] and x["n_chars"] == len(x["text"]) for x in cleaned)
    assert quality.report(none).count() == 0


# 3


def word_edits(a, b):
    rows = [list(range(len(b) + 1))] + [[i] + [0] * len(b) for i in range(1, len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            rows[i][j] = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    return rows[-1][-1]


def test_line_dedup_is_whole(spark):
    r = random.Random(3)
    lines = [prose(r, r.choice([1, 3, 5, 6, 12]), 6) for _ in range(60)]
    for x in list(lines):
        w = x.split()
        k = r.randrange(len(w))
        lines += [" ".join(w[:k] + ["new"] + w[k + 1 :]), " ".join(w[:k] + w[k + 1 :]), " ".join(w[:k] + ["extra"] + w[k:])]
    r.shuffle(lines)
    frame = docs(spark, ["\n".join(lines[k : k + 6]) for k in range(0, len(lines), 6)] + [None, ""])
    got = {(x["doc_id"], x["line_no"]): (x["kept_doc_id"], x["kept_line_no"], x["edits"]) for x in linededup.repeated_lines(frame).collect()}
    seen, wanted = [], {}
    for i, x in enumerate(lines):
        w = x.lower().split()
        if w:
            near = [p for p, v in seen if v == w or len(v) >= 5 and len(w) >= 5 and word_edits(v, w) <= 1]
            if near:
                wanted[divmod(i, 6)] = min(near)
            seen.append((divmod(i, 6), w))
    assert set(got) == set(wanted)
    assert all(got[k][:2] == wanted[k] for k in wanted)
    out = {x["doc_id"]: x["text"] for x in linededup.without_repeated(frame).collect()}
    assert sum(len(t.split("\n")) for t in out.values() if t) <= len(lines) - len(wanted) + 1
    assert out[len(out) - 2] is None


def test_line_dedup_odd(odd, none):
    assert linededup.repeated_lines(odd).count() >= 39
    assert linededup.repeated_lines(none).count() == 0


# 4


def test_license_phrases_and_templates(odd, none, spark):
    texts = ["Released Under the MIT-License!", "x apache license, version 2.0 CC BY-NC cc by nc", " ".join(["filler"] * 50) + " " + licenses.TEXTS[7][1] + " tail", "under the mit", "permission is granted"]
    got = {x["doc_id"]: x for x in licenses.scan(docs(spark, texts)).collect()}
    assert (got[0]["base_labels"], got[0]["n_base"], got[0]["first_word"], got[0]["n_words"]) == ("mit", 1, 1, 5)
    assert (got[1]["base_labels"], got[1]["n_base"], got[1]["first_word"], got[1]["last_word"]) == ("apache-2,cc-by-nc", 3, 1, 9)
    assert got[2]["labels"] == "isc" and got[2]["base_labels"] == "" and got[2]["score"] > 0.9
    assert got[3]["labels"] == "" and got[4]["labels"] == ""
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(none).count() == 0


def plain_templates(text, idf):
    """Labels and best share, every relative position of every template being looked at."""
    found = [w for w in re.split("[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    labels, best, slack = set(), 0.0, licenses.SLACK
    for label, template, keys in licenses.TEXTS:
        t, keys = [w.decode() for w in licenses.plain(template)], [[w.decode() for w in licenses.plain(k)] for k in keys]
        posted = {w.decode() for w in licenses.posted_words(licenses.plain(template), idf)}
        for cell in range(-len(t) // slack - 2, len(found) // slack + 2):
            meet = {w for at, w in enumerate(t) if w in posted for d in range(2 * slack) if 0 <= (i := cell * slack + d + at) < len(found) and found[i] == w}
            begin, end = cell * slack - slack, (cell + 2) * slack + len(t)
            if len(meet) >= min(licenses.MEETING, len(posted)) and all(any(found[i : i + len(k)] == k for i in range(max(0, begin), end + 1)) for k in keys):
                near = found[max(0, begin) : max(0, end)]
                share = sum(min(near.count(w), t.count(w)) for w in set(t)) / len(t)
                best = max(best, share)
                labels |= {label} if share >= licenses.LEAST_SCORE else set()
    return labels, best


def test_license_index_against_every_position(spark):
    r = random.Random(4)
    texts = []
    for label, text, keys in licenses.TEXTS:
        w = text.split()
        for loss in (0.0, 0.1, 0.3, 0.5):
            kept = [x if r.random() >= loss else r.choice(["other", "the", ""]) for x in w]
            texts.append(" ".join([prose(r, r.randrange(20)), *kept, *r.choice([[], keys]), prose(r, r.randrange(20))]))
    frame = docs(spark, [*texts, *texts[:3], None, ""])
    idf, total = licenses.document_frequencies(frame)
    assert total == len(texts) + 5
    labelled = 0
    for x in licenses.scan(frame).collect():
        labels, best = plain_templates([*texts, *texts[:3], None, ""][x["doc_id"]], idf)
        assert set(filter(None, x["labels"].split(","))) == labels | set(filter(None, x["base_labels"].split(",")))
        assert x["n_base"] or abs(x["score"] - best) < 1e-12
        labelled += bool(labels)
    assert labelled >= 2 * len(licenses.TEXTS)


# 5


@pytest.fixture(scope="module")
def field():
    return htmlcrf.trained()


def test_field_on_other_pages(field):
    pages = htmlcrf.labelled_pages(150, seed=77)
    wrong = total = 0
    for page, labels in pages:
        found = htmlcrf.blocks(page)
        assert len(found) == len(labels)
        got = htmlcrf.viterbi(*field, htmlcrf.featured(found))
        wrong += sum(a != b for a, b in zip(got, labels, strict=True))
        total += len(labels)
    assert wrong < 0.01 * total


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(0)
    weights, moves = r.normal(size=(2, htmlcrf.FEATURES)), r.normal(size=(2, 2))
    feats = [list(map(int, r.integers(0, htmlcrf.FEATURES, 5))) for _ in range(9)]
    e = htmlcrf._emissions(weights, feats)
    score = lambda y: sum(e[t, y[t]] for t in range(9)) + sum(moves[a, b] for a, b in zip(y, y[1:], strict=False))
    best = max((tuple(k >> t & 1 for t in range(9)) for k in range(512)), key=score)
    assert tuple(htmlcrf.viterbi(weights, moves, feats)) == best
    one, two = htmlcrf._expected(e, moves)
    every = {tuple(k >> t & 1 for t in range(9)): 0 for k in range(512)}
    z = np.array([score(y) for y in every])
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    assert np.allclose(one[:, 1], sum(q * np.array(y) for q, y in zip(p, every, strict=True)))
    assert np.isclose(two[0, 1], sum(q * sum(a == 0 and b == 1 for a, b in zip(y, y[1:], strict=False)) for q, y in zip(p, every, strict=True)))


def test_pages(spark, field):
    page = (
        "<html><body><nav><ul><li><a href=/>Home</a><li><a>News</a></ul></nav><article><h1>Title&nbsp;one</h1><p>First   text &amp; more &#233;.<br>After\nbreak.<p>Second <b>bold</b> <!-- no --> text."
        "<div class=ad>Buy now!</div><script>var x = '<p>no</p>';</script></article><section id=comments><div class=comment><p>I disagree with this.</p></div></section><footer>&copy; us</footer></body></html>"
    )
    rows = [(1, "u", page, 9), (2, "v", None, 9), (3, None, "", 9), (3, None, "<p", 9), (4, "w", "<article><p>" + "long text. " * 20_000 + "</p></article>", 9)]
    got = htmlcrf.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()
    texts = {x["page_id"]: x["text"] for x in got}
    assert len(got) == 5 and all(x["n_chars"] == len(x["text"]) for x in got)
    assert texts[1] == "Title one\nFirst text & more é. After break.\nSecond bold text."
    assert texts[2] == "" and len(texts[4]) == 20_000 * 11 - 1


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>t</title><style>p{}</style><body><article><p>One of two<p>Two of two</article>",
        "<title>t</title><meta charset=x><article><p>One of two</p><p>Two of two",
        "<article><p>One of two</p><select><option>a<option>b<p>Two of two</p></article>",
        "<article><p>One of two</p><svg><title>x</title><text>no</text><p>Two of two</p></article>",
        "<article><ul><li>One of two<li>Two of two</ul></article>",
        "<article><table><tr><td>One of two<td>Two of two</table></article>",
        "<article><dl><dt>One of two<dd>Two of two</dl></article>",
        "<section><object data=x><b>no</b><article><p>One of two</p><p>Two of two</p></article>",
    ],
)
def test_pages_with_tags_left_out(page):
    assert [b.text for b in htmlcrf.blocks(page)] == ["One of two", "Two of two"]


PARA = "This is an ordinary paragraph of a text that says something, however little."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article><p>{PARA}</p></article>", PARA),
        (f"<div><p>{PARA}</p><p>{PARA}</p><p>{PARA}</p></div>", "\n".join([PARA] * 3)),
        (PARA, PARA),
        (f"<html><body>{PARA}</body></html>", PARA),
        (f"<main><p>{PARA}</p></main><section id=comments><div class=comment><p>Nice one, I say.</p></div></section>", PARA),
        (f"<article><p>{PARA}</p><p>Subscribe to our newsletter was the title of the film that they saw.</p></article>", f"{PARA}\nSubscribe to our newsletter was the title of the film that they saw."),
        (f"<!-- x --!><p>{PARA}</p>", PARA),
        (f"<!--><p>{PARA}</p>", PARA),
        (f"<!---><p>{PARA}</p><!-- unclosed <p>no</p>", PARA),
        (f'<p class="a"b">{PARA}</p><p>{PARA}</p>', f"{PARA}\n{PARA}"),
        (f"<p title=it's>{PARA}</p><p>{PARA}</p>", f"{PARA}\n{PARA}"),
        (f"<p a='x > y' b=c>{PARA}</p></ nothing><p>{PARA}</p><p class='never closed>{PARA}", f"{PARA}\n{PARA}"),
        (f'<body class="home has-sidebar"><div><p>{PARA}</p></div></body>', PARA),
        (f"<table><tr><td>{PARA}</table>", PARA),
        (f"<div class=header><h1>Site</h1></div><div><h1>A title</h1><p>{PARA}</p></div><div class=sidebar><h3>Related</h3><ul><li><a href=/>x</a></ul></div><p>&copy; 2020 us</p>", f"A title\n{PARA}"),
        ("<nav><ul><li><a href=/>Home</a></li></ul></nav><form><p>Search here</p></form><footer>&copy; 2020 us</footer>", ""),
        (f"<p>{PARA}<script>'</p>'; if (a<b) </script >{PARA}", f"{PARA}{PARA}"),
    ],
)
def test_pages_of_other_shells(field, page, text):
    assert htmlcrf.main_text(*field, page) == text


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "x", "<span>" * 50_000 + "</p>" * 50_000, "<x1><x2>" * 25_000, "<p><b>" * 25_000, "<div></em>" * 50_000, "<a b='" * 50_000, "<!--" * 50_000, "<p class=" * 50_000, "< " * 50_000, "&" * 50_000])
def test_deep_and_broken_pages_cost_their_length(field, page):
    import time

    began = time.process_time()
    htmlcrf.main_text(*field, page)
    assert time.process_time() - began < 2


def test_extracted_text_is_the_best_labelling(field):
    weights, moves = field
    for page, _ in htmlcrf.labelled_pages(60, seed=5):
        found = htmlcrf.blocks(page)
        if not 0 < len(found) <= 12:
            continue
        e = [[sum(weights[y, f] for f in feats) for y in (0, 1)] for feats in htmlcrf.featured(found)]
        score = lambda k: sum(e[t][k >> t & 1] for t in range(len(e))) + sum(moves[k >> t & 1, k >> t + 1 & 1] for t in range(len(e) - 1))  # noqa: B023, E731
        best = max(range(1 << len(found)), key=score)
        assert htmlcrf.main_text(weights, moves, page) == "\n".join(b.text for t, b in enumerate(found) if best >> t & 1)


def test_pages_table(field):
    """The article of each page of the table, by a plain reading that knows their layout."""
    import pyarrow.parquet as pq

    for x in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist():
        article = re.search("<article>(.*)</article>", x["html"], re.S)[1]
        article = re.sub("(?s)<(script|style|nav|aside|form)\\b.*?</\\1>|<!--.*?-->|<div class=\"ad\">.*?</div>", "", article)
        parts = [re.sub("\\s+", " ", html.unescape(re.sub("<[^>]*>", "", p.replace("<br>", " ")))).strip() for p in re.split("</?(?:p|h1|h2|div|ul|li|article)\\b[^>]*>", article)]
        assert htmlcrf.main_text(*field, x["html"]) == "\n".join(p for p in parts if p), x["page_id"]


# 6


def plain_fingerprint(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reached(prints, radius=3):
    """The smallest id that each id reaches, by comparing all pairs."""
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("refine", [4096, 3])
def test_near_copies_are_whole(spark, refine):
    r = random.Random(6)
    texts = []
    for _ in range(12):
        base = prose(r, 150).split()
        for _ in range(r.randrange(1, 8)):
            w = list(base)
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    texts += [None, "", "  ", "One", "one", "É a", "é a"]
    got = simhash.near_duplicates(docs(spark, texts), refine=refine).collect()
    prints = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    assert {x["doc_id"]: int(x["fingerprint"], 16) for x in got} == prints
    assert {x["doc_id"]: x["component_id"] for x in got} == reached(prints)
    kept = {x["doc_id"] for x in simhash.keep_one(docs(spark, texts)).collect()}
    assert kept == set(reached(prints).values())


def test_index_against_all_pairs():
    r = np.random.default_rng(6)
    base = r.integers(0, 2**63, 30, dtype=np.uint64)
    codes = np.unique(np.array([int(x) ^ sum(1 << int(b) for b in set(r.integers(0, 64, r.integers(0, 7)))) for x in base for _ in range(30)], np.uint64))
    groups = (codes >> np.uint64(61)).astype(np.int64)
    order = np.lexsort((simhash.gray_rank(codes), groups))
    codes, groups = codes[order], groups[order]
    got = simhash.link_groups(codes, groups, 3)
    wanted = {}
    for g in set(groups.tolist()):
        wanted |= reached({int(i): int(codes[i]) for i in np.flatnonzero(groups == g)})
    assert dict(enumerate(got.tolist())) == wanted


def test_long_chains_of_links(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    found = {x["node"]: x["root"] for x in simhash.components(edges).collect()}
    assert found == {**{i: 0 for i in range(1, 301)}, 1001: 1000}


def test_simhash_odd(odd, none):
    assert simhash.near_duplicates(odd).count() == odd.count()
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == kept.select("doc_id").distinct().count()
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def plain_shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def plain_survivors(rows):
    """Of rows (id, text), the ids that stay, by comparing all pairs: a group's least id, null last."""
    sets, root = [plain_shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for j in range(len(rows)):
        for i in range(j):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                root[find(j)] = find(i)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(i), []).append((doc_id is None, doc_id or 0))
    return sorted(min(g) for g in groups.values())


@pytest.mark.parametrize("block", [4096, 2])
def test_pipeline_drops_similar_texts(spark, monkeypatch, block):
    import corpus_pipeline

    monkeypatch.setattr(nearcopies, "BLOCK", block)
    r = random.Random(16)
    texts = []
    for n in [5, 6, 9, 14, 40, 80, 150, 300, 600] * 3:
        base = prose(r, n).split()
        for _ in range(6):
            w = list(base)
            for _ in range(r.randrange(1 + n // 40)):
                w[r.randrange(len(w))] = "changed"
            texts.append(" ".join(w[r.randrange(2) :]))
    texts += [None, "", "  ", "One", "one", "É a b c d e", "é a b c d e", "a b c d e", "A  b c\nd e"]
    frame = docs(spark, texts)
    kept = corpus_pipeline.drop_near_copies(spark, frame, "")
    assert kept.columns == frame.columns
    assert sorted((x["doc_id"] is None, x["doc_id"]) for x in kept.collect()) == plain_survivors(list(enumerate(texts)))


def test_near_copies_odd(odd, none):
    for frame in (odd, none):
        rows = [(x["doc_id"], x["text"]) for x in frame.collect()]
        kept = nearcopies.keep_one(frame)
        assert kept.columns == frame.columns and sorted((x["doc_id"] is None, x["doc_id"] or 0) for x in kept.collect()) == plain_survivors(rows)


# 7


def plain_leaks(text, item):
    apart = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    d, b = ([w for w in re.split(apart, (t or "").lower()) if w] for t in (text, item))
    offsets = range(1 - len(b), len(d))
    best = 0
    for o in offsets:
        score = run = 0
        for k in range(max(0, -o), min(len(b), len(d) - o)):
            same = d[o + k] == b[k]
            score += 1 if same else -decontam.PENALTY
            run = 0 if score < 0 else run + same
            score = max(score, 0)
            best = max(best, run)
    return best if best and best >= min(decontam.LEAST, -(-len(b) * 4 // 5)) else 0


@pytest.mark.parametrize("room", [32 << 20, 0])
def test_leaks_against_plain_search(spark, monkeypatch, room):
    from lutework.llm import common

    monkeypatch.setattr(common, "BROADCAST_BYTES", room)
    r = random.Random(7)
    items = [prose(r, n) for n in (9, 14, 20, 45, 5)]
    texts = [prose(r, 80)]
    for item in items[:4]:
        w = item.split()
        changed = [x if i % 7 else "other" for i, x in enumerate(w)]
        texts += [prose(r, 30) + " " + item + ". " + prose(r, 30), prose(r, 10) + " " + " ".join(changed) + " " + prose(r, 9), " ".join(w[len(w) // 2 :]) + " " + prose(r, 20), item.upper().replace(" ", ", ")]
    # items of every length with one word in six, on average, replaced
    for n in [*range(1, 16), 30]:
        items.append(" ".join(f"i{n}x{k}" for k in range(n)))
        texts += [" ".join(["before"] * r.randrange(3) + [w if r.random() < 0.84 else "other" for w in items[-1].split()] + ["after"] * r.randrange(3)) for _ in range(5)]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)] + [(99, None, "x")], "item_id long, text string, doc_id string")
    got = {(x["doc_id"], x["item_id"]): x["matched"] for x in decontam.leaks(docs(spark, texts), benchmark).collect()}
    wanted = {(i, j): n for i, t in enumerate(texts) for j, item in enumerate(items) if (n := plain_leaks(t, item))}
    assert got == wanted and len(got) >= 30
    kept = {x["doc_id"] for x in decontam.without_leaks(docs(spark, texts), benchmark).collect()}
    assert kept == set(range(len(texts))) - {i for i, _ in wanted}


def test_leaks_odd(odd, none, spark):
    benchmark = spark.createDataFrame([(0, prose(random.Random(1), 30))], "item_id long, text string")
    assert decontam.leaks(odd, benchmark).count() == 0
    assert decontam.leaks(none, benchmark).count() == 0 and decontam.leaks(odd, benchmark.where("false")).count() == 0
    assert decontam.without_leaks(odd, benchmark).columns == odd.columns


# 8

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("ids", [[1], [2**32 - 1, 0, 5], list(range(1024)), list(range(1025)), [7] * 3000, [3] * 1000 + [2**31] * 20 + [1] * 1005])
def test_blocks_round_trip(ids):
    x = np.array(ids, np.uint32)
    payload, starts = tokens.pack(x)
    assert np.array_equal(tokens.unpack(payload, starts), x)


def test_encoder_is_the_library():
    from tokenizers import Tokenizer

    t, mine = Tokenizer.from_file(PATH), tokens.WordEncoder(PATH)
    texts = [x or "" for x in ODD] + ["don't 's 12.5% a_b [x] `q` ~|{}", "a<|endoftext|>b <|STARTOFTEXT|>", "".join(map(chr, range(1, 0x250))), " ".join(map(chr, range(1, 0x250))), "İ ΣΑΣ e ́ ﬁ\x85z　q"]
    for x in texts:
        assert mine(x).tolist() == t.encode(x, add_special_tokens=False).ids


def test_token_files(spark, odd, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    r = random.Random(8)
    texts = [prose(r, r.randrange(2000)) for _ in range(60)] + ODD
    order = list(range(len(texts)))
    r.shuffle(order)
    frame = docs(spark, texts).repartition(5)
    got = {x["doc_id"]: x for x in tokens.encoded(frame, PATH).collect()}
    at = 0
    for i, x in enumerate(texts):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert tokens.encoded(odd, PATH).count() == odd.count() and tokens.encoded(none, PATH).count() == 0


def test_very_many_tiny_documents(spark):
    import time

    from lutework.llm.queries import END_ID, TOKENIZER

    frame = spark.range(200_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("").alias("text"))
    began = time.time()
    got = tokens.encoded(frame, public_tokenizers.path(TOKENIZER), END_ID).agg(F.count("*"), F.sum("n_tokens"), F.max("start")).first()
    assert tuple(got) == (200_000, 200_000 + 66_667, 266_666) and time.time() - began < 60


@pytest.mark.parametrize("change", [{"dropout": 0.1}, {"ignore_merges": True}, {"unk_token": "<unk>"}, {"byte_fallback": True}, {}])
def test_tokenizers_with_other_models_encode_whole_texts(tmp_path, change):
    import json

    from lutework.llm.queries import TOKENIZER

    stated = json.load(open(public_tokenizers.path(TOKENIZER)))
    stated["model"] |= change
    if "unk_token" in change:
        stated["model"]["vocab"]["<unk>"] = 49408
    (tmp_path / "t.json").write_text(json.dumps(stated))
    assert tokens.WordEncoder(str(tmp_path / "t.json")).own_rules == (not change)


# 9


def test_toxicity_held_out(spark):
    r = random.Random(9)
    texts, toxic = [], []
    for _ in range(500):
        bad = r.random() < 0.3
        w = prose(r, 60).split()
        for _ in range(3 * bad):
            w[r.randrange(60)] = r.choice(["idiot", "blarghoid", "blarghest"])
        texts.append(" ".join(w))
        toxic.append(int(bad))
    labels = spark.createDataFrame([(i, t, 1) for i, t in enumerate(toxic)] + [(9999, 1, 1), (3, None, 1)], "doc_id long, toxic int, quality int")
    got = toxicity.report(docs(spark, texts), labels).collect()
    for x in got:
        assert x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0)
        assert 0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5)
    out = [x for x in got if x["held_out"]]
    assert sum(x["predicted"] == toxic[x["doc_id"]] for x in out) >= 0.95 * len(out)


def test_toxicity_of_the_table(spark):
    """Held-out documents of the table, whose labels aren't learned."""
    sf = "/root/testdata/sf0.01"
    frame, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.report(frame, labels).where("held_out").join(labels.where("toxic IS NOT NULL"), "doc_id").collect()
    assert len(got) >= 50 and sum(x["predicted"] == x["toxic"] for x in got) >= 0.9 * len(got)  # from some 330 labels


def test_toxicity_odd(spark, odd, none):
    labels = spark.createDataFrame([(3, 0, 1), (3, 0, 1), (5, 0, 1)], "doc_id long, toxic int, quality int")
    got = toxicity.report(odd, labels).collect()
    assert len(got) == odd.count() and {x["score"] for x in got} == {0.0}
    assert toxicity.report(none, labels.where("false")).count() == 0
    both = labels.unionByName(spark.createDataFrame([(8, 1, 1), (9, 1, 1), (6, 1, 1)], labels.schema))
    assert toxicity.without_toxic(odd, both).columns == odd.columns


# 10


def test_chat_round_trip(spark):
    r = random.Random(10)
    pieces = ["</s>", "<s>", "[INST]", "[/INST]", "[ANS]", "[ROLE=6F]", "\\", "\\\\", " ", "\n", "ok", "é", " </s>\n<s>[SYS] "]
    rows = []
    for c in range(40):
        for turn in range(r.randrange(1, 9)):
            rows.append((c, turn, r.choice(["system", "user", "assistant", "tool", "", None]), r.choice([None, "", "".join(r.choices(pieces, k=8))])))
    rows += [(100, i, "user", f"t{i}") for i in range(70)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {x["conv_id"]: x for x in chat.digest(chat.formatted(chat.best_paths(chat.linear_messages(frame)))).collect()}
    for c in {x[0] for x in rows}:
        turns = [(role or "", text or "") for k, _, role, text in rows if k == c]
        each = "".join(f"{role}\n{text}\n" for role, text in turns)
        loss = "".join(text for role, text in turns if role == "assistant")
        x = got[c]
        assert (x["n_turns"], x["turns_sha256"]) == (len(turns), hashlib.sha256(each.encode()).hexdigest())
        assert (x["loss_chars"], x["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_reply_trees(spark):
    rows = [(1, 1, None, "user", "q", 1.0), (1, 2, 1, "assistant", "bad", 1.0), (1, 3, 1, "assistant", "good", 5.0), (1, 4, 3, "user", "thanks", 1.0), (1, 5, 2, "user", "why", 1.0), (2, 1, 9, "user", "orphan", None),
            (3, 1, 2, "user", "cycle", 1.0), (3, 2, 1, "user", "cycle", 1.0)]
    frame = spark.createDataFrame(rows, "tree_id long, msg_id int, parent_id int, role string, text string, score double")
    paths = chat.best_paths(frame, branches=2).orderBy("tree_id", "rank", "depth").collect()
    told = {}
    for x in paths:
        told.setdefault((x["tree_id"], x["rank"]), []).append(x["text"])
    assert told == {(1, 1): ["q", "good", "thanks"], (1, 2): ["q", "bad", "why"], (2, 1): ["orphan"]}
    assert chat.best_paths(frame.where("false")).count() == 0


# All of them


def test_clashing_columns(spark):
    r = random.Random(20)
    names = ["row", "n", "h", "id", "i", "t", "m", "key", "root", "kept", "kept_lines", "score", "label", "doc", "hits", "gone", "x", "__w", "__id", "__copies", "count"]
    rows = [(i, prose(r, 40), "s", *names) for i in range(6)] + [(None, None, None, *names), (3, "", None, *names)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(6)], "doc_id long, toxic int, text string")
    benchmark = spark.createDataFrame([(0, prose(r, 20), "x")], "item_id long, text string, doc string")
    outputs = [
        quality.cleaned(frame), linededup.without_repeated(frame), nearcopies.keep_one(frame), simhash.keep_one(frame), decontam.without_leaks(frame, benchmark),
        mixing.mix_documents(frame), toxicity.without_toxic(frame, labels),
    ]
    for out in outputs:
        assert out.columns == frame.columns and all(x["kept_lines"] == "kept_lines" for x in out.collect())
    for report in (mixing.mix_report, quality.report, licenses.scan, simhash.near_duplicates):
        assert report(frame).count() == 8
    assert tokens.encoded(frame, PATH).count() == 8 and linededup.repeated_lines(frame).count() >= 0
    pages = spark.createDataFrame([(1, "u", "<article><p>Some text that stands here.</p></article>", "x", "y", "z")], "page_id long, url string, html string, text string, n_chars string, block string")
    assert [c for c in htmlcrf.extract(pages).columns] == ["page_id", "url", "text", "n_chars"] and htmlcrf.extract(pages).count() == 1
    turns = spark.createDataFrame([(1, k, "user", f"t{k}", 1, 2, 3.0, 4, 5) for k in range(3)], "conv_id long, turn long, role string, text string, tree_id long, msg_id long, score double, rank long, depth long")
    assert [x["n_turns"] for x in chat.digest(chat.formatted(chat.best_paths(chat.linear_messages(turns)))).collect()] == [3]


# The pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    columns = frame.columns
    before = {x["doc_id"] for x in frame.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, sf)
        assert frame.columns == columns, name
        frame = spark.createDataFrame(frame.collect(), frame.schema)
        assert {x["doc_id"] for x in frame.collect()} <= before
        if name == "toxicity":
            toxic = {x["doc_id"]: x["toxic"] for x in spark.read.parquet(f"{sf}/labels.parquet").where("toxic IS NOT NULL").collect() if x["doc_id"] in before}
            kept = {x["doc_id"] for x in frame.collect()}
            assert sum((i in kept) != bool(t) for i, t in toxic.items()) >= 0.9 * len(toxic)
        if name == "simhash":
            rows = [(x["doc_id"], x["text"]) for x in frame.collect()]
            assert plain_survivors(rows) == sorted((i is None, i) for i, _ in rows)
        if name == "mixing":
            copies = Counter(x["doc_id"] for x in frame.collect())
            assert all(copies[x["doc_id"]] * x["size"] == x["taken"] for x in report)
        if name == "decontamination":
            items = [x["text"] for x in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert not any(plain_leaks(x["text"], t) for x in frame.collect() for t in items)
            report = mixing.mix_report(frame).collect()
    out = corpus_pipeline.STAGES[-1][1](spark, frame, sf)
    assert out.count() == frame.count() and corpus_pipeline.run(spark, sf).count() == frame.count()
