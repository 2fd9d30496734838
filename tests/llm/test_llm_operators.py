"""The numbered operators against plain versions, and odd rows."""

import hashlib
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from quire.llm import html_extract, license_scan, line_dedup, media_columns, quality_classifier, quality_rules, secret_scan, source_mix
from quire.llm import sentencepiece_codec as sp

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, media string, label string"
ODD = [None, "", " ", "\n\n", "a", "Ünï çødé  x\ty\n", "▁ <s> \x00 🎼", "MIT License", "token = abcdefgh1", "word " * 3000]


def docs(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or ""), "x", "y", "z") for i, t in enumerate(texts)], DOCS)


def test_sentencepiece_equals_the_library(spark, monkeypatch):
    monkeypatch.setattr(sp, "SHORT", 8)
    c = sp.Codec(MODEL)
    rng = random.Random(1)
    texts = [t or "" for t in ODD] + ["".join(rng.choices("ab cdeé.\n  1ß語", k=rng.randrange(60))) for _ in range(300)]
    for t in texts:
        ids = c.lib.encode(t)
        assert c.encode(t) == ids and c.decode(ids) == c.lib.decode(ids)
    out = sp.sentencepiece_encode(docs(spark, ODD), MODEL)
    for r in out.collect():
        ids = c.lib.encode(ODD[r.doc_id] or "")
        assert r.ids == ids and r.decoded == c.lib.decode(ids) and r.label == "z"
    assert sp.sentencepiece_digests(docs(spark, []), MODEL).count() == 0


def test_a_wrong_merge_is_noticed():
    c = sp.Codec(MODEL)
    with pytest.raises(ValueError, match="the library gives"):
        c.compare(["▁hello"], [[1, 2]])


def test_media_round_trip_and_carving(spark):
    png = b"\x89PNG\r\n\x1a\n"
    for kind, body in ((b"IHDR", bytes(13)), (b"IEND", b"")):
        png += len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    wav = media_columns.wrap_wav(b"\x80" * 64)
    rows = [(0, wav, "image/png"), (1, b"xx" + png + b"BM" + wav, None), (2, png[:-1], "image/png"), (3, None, None), (4, b"", "a"), (5, b"RIFF" + bytes(60), None), (6, wav + b"tail", "audio/wav")]
    df = spark.createDataFrame(rows, "doc_id long, file binary, declared string")
    got = {r.doc_id: r.media for r in media_columns.media_columns(df, "file", "declared").collect()}
    assert (got[0].type, got[0].length, got[0].corrected) == ("audio/wav", len(wav), True)
    assert [(e.offset, e.length, e.type) for e in got[1].embedded] == [(2, len(png), "image/png"), (4 + len(png), len(wav), "audio/wav")]
    assert all(got[i].type is None and not got[i].embedded for i in (2, 3, 4, 5)) and got[6].trailing == 4
    made = media_columns.media_features(media_columns.media_columns(media_columns.text_media(docs(spark, ODD)), "file", "declared"))
    for r in made.collect():
        raw = (ODD[r.doc_id] or "").encode()
        pad = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))


def flac(total, frames):
    """A mono 16-bit stream of frames of 192 samples: constant, verbatim, and Rice-coded with a parameter of 0."""
    out = b"fLaC\x80\x00\x00\x22" + bytes(10) + (44100 << 44 | 15 << 36 | total).to_bytes(8, "big") + bytes(16)
    for i, kind in enumerate(frames):
        head = bytes([0xFF, 0xF8, 0x10, 0x08, i])
        head += bytes([media_columns.crc8(head)])
        body = {"constant": b"\x00\x12\x34", "verbatim": b"\x02" + b"BM\xff\xf8" * 96, "rice": b"\x10" + (((1 << 192) - 1) << 6).to_bytes(26, "big")}[kind]  # method, partitions and parameter are 10 zero bits
        out += head + body + media_columns.crc16(head + body).to_bytes(2, "big")
    return out


def test_carved_bytes_and_ends_of_objects(spark):
    assert (media_columns.crc8(b"123456789"), media_columns.crc16(b"123456789")) == (0xF4, 0xFEE8)
    wav = media_columns.wrap_wav(b"\x80" * 64)
    sound, open_ended = flac(576, ["constant", "verbatim", "rice"]), flac(0, ["rice", "constant"])
    pdf = b"%PDF-1.7\nfirst\n%%EOF\nchange\n%%EOF"
    rows = [(0, sound + b"tail", "audio/wav"), (1, b"x" + open_ended + b"yy" + wav, "audio/wav"), (2, b"x" + pdf + b"\n" + wav + pdf, None), (3, sound[:-1], None), (4, None, None), (5, wav, "audio/wav")]
    df = spark.createDataFrame(rows, "doc_id long, file binary, declared string")
    got = sorted((r.doc_id, r.offset, r.type, r.corrected, bytes(r.object)) for r in media_columns.carve_media(df, "file", "declared").collect())
    at = 1 + len(open_ended) + 2
    assert [r for r in got if r[0] in (0, 1, 5)] == [(0, 0, "audio/flac", True, sound), (1, 1, "audio/flac", False, open_ended), (1, at, "audio/wav", False, wav), (5, 0, "audio/wav", False, wav)]
    assert [r[1:] for r in got if r[0] == 2] == [(1, "application/pdf", False, pdf), (len(pdf) + 2, "audio/wav", False, wav), (len(pdf) + 2 + len(wav), "application/pdf", False, pdf)]
    assert not [r for r in got if r[0] in (3, 4)]
    media = {r.doc_id: r.media for r in media_columns.media_columns(df, "file", "declared").collect()}
    assert media[0].trailing == 4 and [e.type for e in media[1].embedded] == ["audio/flac", "audio/wav"]


def test_flow_routes_overlapping_sources():
    flow = source_mix.min_cost_flow({"a": 10, "b": 10, "ab": 10}, {"a": ["A"], "b": ["B"], "ab": ["A", "B"]}, {"A": 18, "B": 12}, 2)
    assert sum(v for (_, s), v in flow.items() if s == "A") == 18 and sum(v for (_, s), v in flow.items() if s == "B") == 12
    assert all(sum(v for (q, _), v in flow.items() if q == p) <= 10 for p in ("a", "b", "ab"))  # no repetition is needed
    assert source_mix.quotas({"A": 10, "B": 100}, {"A": 5, "B": 1}, 100, 2) == {"A": 20.0, "B": 80.0}


def least_cost(offers, members, wanted, repeats):
    """Most words and their least cost, by shortest ways one after the other over the whole network."""
    arcs = []

    def add(u, v, room, cost):
        arcs.extend(([u, v, room, cost], [v, u, 0, -cost]))

    for p, n in offers.items():
        for k in range(repeats):
            add("start", p, n, k)
        for s in members[p]:
            add(p, s, 10**9, 0)
    for s, n in wanted.items():
        add(s, "end", n, 0)
    words = cost = 0
    while True:
        far, by = {"start": 0}, {}
        for _ in range(len(offers) + len(wanted) + 2):
            for i, (u, v, room, c) in enumerate(arcs):
                if room > 0 and u in far and far[u] + c < far.get(v, 10**9):
                    far[v], by[v] = far[u] + c, i
        if "end" not in far:
            return words, cost
        way, v = [], "end"
        while v != "start":
            way.append(by[v])
            v = arcs[by[v]][0]
        amount = min(arcs[i][2] for i in way)
        for i in way:
            arcs[i][2] -= amount
            arcs[i ^ 1][2] += amount
        words, cost = words + amount, cost + amount * far["end"]


def test_flow_is_of_least_cost():
    rng = random.Random(1)
    for _ in range(200):
        sources = [f"s{i}" for i in range(rng.randint(1, 4))]
        offers = {f"p{i}": rng.randint(0, 9) for i in range(rng.randint(1, 7))}
        members = {p: rng.sample(sources, rng.randint(1, len(sources))) for p in offers}
        wanted, repeats = {s: rng.randint(0, 25) for s in sources}, rng.randint(1, 3)
        flow = source_mix.min_cost_flow(offers, members, wanted, repeats)
        given = {p: sum(v for (q, _), v in flow.items() if q == p) for p in offers}
        assert all(given[p] <= repeats * offers[p] for p in offers) and all(s in members[p] for p, s in flow)
        assert all(sum(v for (_, q), v in flow.items() if q == s) <= wanted[s] for s in sources)
        cost = sum(k * max(0, min(offers[p], given[p] - k * offers[p])) for p in offers for k in range(repeats))
        assert (sum(given.values()), cost) == least_cost(offers, members, wanted, repeats)


def test_targets_against_a_plain_loop(spark):
    rng = random.Random(2)
    for _ in range(100):
        sizes = {f"s{i}": rng.randint(0, 60) for i in range(rng.randint(1, 6))}
        weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sizes)}
        total, fixed = 1.5 * sum(sizes.values()), {}
        while True:
            rest = {s: (total - sum(fixed.values())) * weights[s] / sum(weights[q] for q in sizes if q not in fixed) for s in sizes if s not in fixed}
            over = [s for s in rest if rest[s] > 2 * sizes[s]]
            if not over:
                break
            fixed |= {s: 2.0 * sizes[s] for s in over}
        got = source_mix.quotas(sizes, weights, total, 2)
        assert all(abs(got[s] - (fixed | rest)[s]) < 1e-6 for s in sizes)
    long = "w " * 400_000
    rows = [(1, long, "a"), (1, long, "a"), (1, "x y", "b"), (None, "z", "b"), (2, "", None)]
    mixed = source_mix.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(mixed) == 5 and len({r.copies for r in mixed if r.size == 400_000}) == 1


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(40), rng.choice(["a", "a", "a", "b", None]), "kept") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = source_mix.mix_sources(df).collect()
    assert len(got) == 3000 and all(0 <= r.copies <= 2 for r in got)
    for s in ("a", "b", None):
        mine = [r for r in got if r.source == s]
        assert mine[0].source_size == sum(r.size for r in mine)
        assert abs(sum(r.size * r.copies for r in mine) - mine[0].target) <= 40
    assert sorted(map(str, got)) == sorted(map(str, source_mix.mix_sources(df.repartition(7)).collect()))
    lists = spark.createDataFrame([(1, "a b c", ["x", "y"]), (2, "d e", ["x"]), (3, None, []), (4, "f", None)], "doc_id long, text string, sources array<string>")
    assert source_mix.mix_sources(lists, sources_col="sources").count() == 4
    assert source_mix.mix_sources(df.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header>site</header><nav><ul><li>one<li>two</ul></nav>
<div class="ad">buy</div><article><h1>Head {0}</h1><p>First &amp; <b>bo</b>ld<p>Second  line<br>after<script>var a="</p>";</script><form>f</form><div class="share-links">s</div>
<aside>x</aside></article><section id="comments"><article>no</article></section><footer>&copy; host</footer></body></html>"""


def test_html_main_text(spark):
    rows = [(i, f"https://h.example/{i}", PAGE.replace("{0}", str(i))) for i in range(4)]
    rows += [(10, None, None), (11, "u", ""), (12, "//h2", "plain <i>text</i> &lt;3 <b"), (13, "//h2/x", "<main>m<p>n</main>out"), (14, "//h2/y", "<!-- open")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("old"))
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.html_extract(df).collect()}
    for i in range(4):
        assert got[i][0] == f"Head {i} First & bold Second line after"
    assert [got[i][0] for i in (10, 11, 12, 13, 14)] == ["", "", "plain text <3", "m n", ""]
    assert html_extract.html_extract(df.limit(0)).count() == 0


def test_template_drops_blocks_that_repeat_outside_an_article(spark):
    rows = [(i, "http://h/", f"<div><p>Same on all</p><p>Own text {i}</p></div>") for i in range(5)]
    got = html_extract.html_extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r.text for r in got) == [f"Own text {i}" for i in range(5)]


def extracted(spark, pages, host="h"):
    rows = [(i, f"http://{host}/{i}", p) for i, p in enumerate(pages)]
    return {r.page_id: r.text for r in html_extract.html_extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_article_text_stays_and_teasers_go(spark):
    body = "".join(f"<p>Paragraph {k} of {{0}} with some words of its own.</p>" for k in range(4))
    page = """<article><p>Teaser {0}</p></article><article><div class="entry-header"><h1 id="social-impact">Head {0}</h1></div><p class="notice-period">Notice period</p>
<p>Common passage on all pages</p>""" + body + """<div class="share-buttons">share {0}</div><div id="author">About the site</div></article><section id="comments"><p>reader {0}</p></section>"""
    got = extracted(spark, [page.replace("{0}", f"n{i}") for i in range(4)])
    for i in range(4):
        assert got[i] == f"Head n{i} Notice period Common passage on all pages " + " ".join(f"Paragraph {k} of n{i} with some words of its own." for k in range(4))
    # alone on its host a page has no template: the box of template text stays
    assert extracted(spark, [page.replace("{0}", "n0")])[0].endswith("own. About the site")
    # copies of one page are no template
    assert "About the site" in extracted(spark, [page.replace("{0}", "n0")] * 4)[2]


def test_the_template_picks_the_text_of_pages_without_containers(spark):
    pages = [f"<div><p>Same line</p></div><div><p>Own text {i}</p></div>" for i in range(5)]
    assert extracted(spark, pages) == {i: f"Own text {i}" for i in range(5)}
    assert extracted(spark, pages[:2]) == {i: f"Same line Own text {i}" for i in range(2)}


def test_long_and_deep_pages(spark):
    deep = "<div>" * 8000 + "deep" + "</div>" * 8000
    long = "<article>" + "<p>word</p>" * 50_000 + "</article>"
    got = extracted(spark, [deep, deep, long, long])
    assert got[0] == got[1] == "deep" and got[2] == got[3] == " ".join(["word"] * 50_000)


def brute_nested(found, places):
    """Pairs by definition: all tokens of one class between two neighbouring tokens of the other."""
    gap = lambda x, other: {sum(o < i for o in other) for i in x}
    order = sorted(places, key=lambda c: (len(places[c]) // len({found[i] for i in places[c]}), -len(places[c]), c))
    kept = []
    for c in order:
        if all(len(gap(places[c], places[k])) == 1 or len(gap(places[k], places[c])) == 1 for k in kept):
            kept.append(c)
    return set(kept)


def test_classes_and_nesting_against_brute_force(spark):
    rng = random.Random(5)
    for _ in range(300):
        found = [rng.randrange(8) for _ in range(rng.randrange(1, 20))]
        places = html_extract.class_places(found, {t: t % 3 for t in range(6)})
        assert html_extract.nested(found, places) == brute_nested(found, places)
    tags = ["<p>a</p>", "<ul><li>b</li></ul>", "<h2>c</h2>", "<div><p>d</p></div>"]
    pages = ["<body>" + "".join(rng.choices(tags, k=rng.randrange(1, 5))) + "</body>" for _ in range(12)]
    df = spark.createDataFrame([(i, "http://h/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    tokens = [html_extract.Page(p).tokens for p in pages]
    counts = {t: tuple(f.count(t) for f in tokens) for f in tokens for t in f}
    frequent = {t: v for t, v in counts.items() if sum(map(bool, v)) >= 6}
    ordered = {}
    for t, v in frequent.items():
        ordered.setdefault(v, set()).add(t)
    ordered = {v: ts for v, ts in ordered.items() if len({tuple(t for t in f if t in ts) for f in tokens if set(f) & ts}) == 1}
    of = {t: v for v, ts in ordered.items() for t in ts}
    got = html_extract.host_templates(html_extract._parsed(df, "page_id", "url", "html")).collect()
    template = dict(zip(got[0].known, got[0].classes)) if got else {}  # noqa: B905
    assert set(template) <= set(of) and len(set(template.values())) == len({of[t] for t in template})
    assert all({u for u in template if template[u] == c} == ordered[of[t]] for t, c in template.items())
    for f in tokens:
        places = html_extract.class_places(f, template)
        assert brute_nested(f, places) == set(places)


def test_co_training_learns_both_views(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        text = ("LOUD!! " * 60) if bad else " ".join(word() for _ in range(80)) + "."
        rows.append((i, text, "en", "spam" if bad and rng.random() < 0.9 else "news", len(text)))
        if i % 3 == 0:
            labels.append((i, 0 if bad else 1))
    rows += [(1000, None, None, None, None), (1001, "", "en", "news", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    lab = spark.createDataFrame([*labels, (5000, 1), (1, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_classifier.quality_classifier(df, lab).collect()}
    assert len(got) == 602
    assert sum(got[i].keep == (i % 5 != 0) for i in range(600)) >= 595
    none = quality_classifier.quality_classifier(df, lab.limit(0)).collect()
    assert all(abs(r.score - 0.5) < 1e-9 for r in none)


def test_each_view_teaches_the_other(spark):
    """Text tells even documents apart, the source odd ones; labels are few, and no view alone can learn both."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows, labels = [], []
    for i in range(1200):
        bad = i // 2 % 3 == 0
        text = " ".join(["LOUD!!"] * 40 if bad and i % 2 == 0 else [word() for _ in range(60)])
        source = ("spam" if bad else "news") if i % 2 else "misc"
        rows.append((i, text, "en", source, len(text)))
        if rng.random() < 0.3:
            labels.append((i, int(not bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("good", F.lit("clash")).withColumn("state", F.lit(9))
    report = []
    out = quality_classifier.quality_classifier(df, spark.createDataFrame(labels, "doc_id long, quality int"), report=report).collect()
    for view in ("text_view", "meta_view"):
        assert all(n > 0 for _, v, _, n in report if v == view) and len([1 for _, v, _, _ in report if v == view]) == 6
    right = lambda f: sum((f(r) >= 0.5) == (r.doc_id // 2 % 3 != 0) for r in out) / len(out)
    assert right(lambda r: r.score) > 0.97 > max(right(lambda r: r.text_score), right(lambda r: r.meta_score))


def test_quality_of_odd_rows(spark):
    long = "word " * 300_000
    rows = [(1, long, "en", "a", len(long)), (1, long, "en", "a", len(long)), (2, None, None, None, None), (None, "x", "en", "a", 1), (3, "", "", "", -1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("s"))
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1)], "doc_id long, quality int")
    got = quality_classifier.quality_classifier(df, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "2", "3", "None"] and all(0 < r.score < 1 for r in got)
    assert quality_classifier.quality_classifier(df.limit(0), labels).count() == 0


def test_license_phrases_and_notices(spark):
    long = "x " + "Permission is hereby granted, free of charge, to every person obtaining a copy of this software and associated documentation files"
    texts = [*ODD, "The MIT\nLicense, mit license; CC-BY", "gnu general public", long, "K mit license İ apache LICENSE"]
    got = {r.doc_id: r for r in license_scan.license_scan(docs(spark, texts)).collect()}
    assert len(got) == len(texts) and got[0].n_words == 0 and got[0].labels == "" and got[0].score == 0.0
    r = got[len(ODD)]
    assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (3, 1, 5, "cc-by,mit")
    assert got[len(ODD) + 1].n_base == 0
    assert got[len(ODD) + 2].labels == "mit" and got[len(ODD) + 2].n_base == 0 and 0.8 <= got[len(ODD) + 2].score < 1
    assert got[len(ODD) + 3].base_labels == "apache,mit"


def plain_licenses(text, least=0.8, slack=2):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    ws = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    base, found, shares = [], set(), [0.0]
    for phrase, label in license_scan.PHRASES.items():
        body = phrase.split()
        base += [(i, label) for i in range(len(ws)) if ws[i : i + len(body)] == body]
    licenses = [(re.findall(r"[a-z0-9]+", t.lower()), label, 4) for label, t in license_scan.LICENSES.items()]
    for body, label, k in [(n.split(), label, 2) for n, label in license_scan.NOTICES.items()] + licenses:
        grams = [body[i : i + k] for i in range(len(body) - k + 1)]
        votes = {}
        for p, g in enumerate(ws[i : i + k] for i in range(len(ws) - k + 1)):
            for q, h in enumerate(grams):
                if g == h:
                    votes.setdefault(p - q, []).append(p)
        for d in votes:
            near = {e: votes[e] for e in votes if d <= e <= d + slack}
            places = [p for ps in near.values() for p in ps]
            share = len({p - e for e, ps in near.items() for p in ps}) / len(grams)
            if share < least:
                continue
            span, at, n = ws[min(places) : max(places) + k], 0, 0
            for w in body:
                near = span[at : at + slack + 2]
                if w in near:
                    at, n = at + near.index(w) + 1, n + 1
            if n >= least * len(body):
                found.add(label)
                shares.append(share)
    starts = [i for i, _ in base]
    labels = sorted({b for _, b in base})
    return len(ws), len(base), min(starts, default=None), max(starts, default=None), ",".join(labels), ",".join(sorted({*labels, *found})), max([*shares, *[1.0 for _ in base]])


def test_a_stray_hit_cuts_no_notice(spark):
    mit = next(n for n, label in license_scan.NOTICES.items() if label == "mit").split()
    put_in = [*mit[:9], "very", *mit[9:]]
    texts = [" ".join(x) for x in (put_in, ["permission", "is", *put_in], ["permission", "is", "so", *put_in, *mit])]
    got = license_scan.license_scan(docs(spark, texts)).orderBy("doc_id").collect()
    assert [r.labels for r in got] == ["mit"] * 3 and all(r.score > 0.9 for r in got)
    assert len({(s.first // 10, s["last"] // 10) for s in got[2].spans}) >= 2


def test_media_marks_without_ends_take_linear_time():
    began = time.time()
    assert media_columns.sniff(b"%PDF-1.4 " * 200_000) == []
    start = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02data"
    assert media_columns.sniff(start * 100_000) == []
    assert time.time() - began < 20
    pdf = b"%PDF-1.4 x %%EOF y %%EOF"
    assert media_columns.sniff(b"%PDF-1.7 " + pdf + b" %PDF-1.4") == [(9, len(pdf), "application/pdf")]
    jpeg = start + b"\xff\x00\xff\xd0more\xff\xc4\x00\x04\xff\xd9\xff\xda\x00\x02rest\xff\xff\xd9"
    assert media_columns.sniff(start + jpeg + b"tail") == [(len(start), len(jpeg), "image/jpeg")]


def test_a_text_without_anchors_holds_no_template():
    """Taking the anchors out of a template leaves fewer k-grams than a span needs."""
    bodies = license_scan._bodies(license_scan.PHRASES, license_scan.NOTICES, license_scan.LICENSES)
    need = license_scan.anchors(bodies, 0.8)
    assert 0 < len(need) <= license_scan.MAX_ANCHORS and not license_scan.COMMON & set(need)
    for _, body, _, base, k in bodies:
        grams = [body[i : i + k] for i in range(len(body) - k + 1)]
        left = sum(not set(g) & set(need) for g in grams)
        assert left < len(grams) if base else left / len(grams) < 0.8


def test_licenses_against_a_plain_loop(spark):
    rng = random.Random(9)
    phrases = [*license_scan.PHRASES, *license_scan.NOTICES]
    texts = list(ODD)
    for _ in range(250):
        ws = []
        for _ in range(rng.randrange(6)):
            body = rng.choice(phrases).split()
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                at = rng.randrange(len(body) + 1)
                body[at : at + rng.choice([0, 1])] = rng.choice([[], ["x"], ["The"], ["by"]])
            if rng.random() < 0.15:
                rng.shuffle(body)
            ws += body + rng.choices(["a", "License", "cc", "by", "K", "é"], k=rng.randrange(5))
        texts.append(rng.choice([" ", ", ", "\n"]).join(ws))
    for text in license_scan.LICENSES.values():
        for often in (0, 1, 3, 8):  # words left out, put in or changed
            body = text.split()
            for _ in range(often):
                at = rng.randrange(len(body))
                body[at : at + rng.choice([0, 1])] = rng.choice([[], ["x"], ["The"]])
            texts += ["Copyright 2001 N. N.\n" + " ".join(body) + "\nend", " ".join(body[: len(body) // 2])]
    texts += ["cc by " * 60 + "nc", "word " * 200_000]
    got = {r.doc_id: tuple(r)[1:8] for r in license_scan.license_scan(docs(spark, texts)).collect()}
    assert {i: plain_licenses(t) for i, t in enumerate(texts)} == {i: (*r[:6], r[6]) for i, r in got.items()}
    assert license_scan.license_scan(docs(spark, [])).count() == 0


def test_quality_columns_against_plain_loops(spark):
    rng = random.Random(10)
    texts = ODD + ["".join(rng.choices(["alpha ", "beta ", "# ", "$x ", "é ", "\n", "a.\n", "gamma delta "], k=rng.randrange(80))) for _ in range(150)]
    for r in quality_rules.quality_rules(docs(spark, texts)).collect():
        t = texts[r.doc_id] or ""
        ws, lines, seen, dup = re.findall("[^\x20\x09-\x0d]+", t), t.split("\n"), set(), 0
        for line in lines:
            if re.search("[^\x20\x09-\x0d]", line):
                dup += line in seen
                seen.add(line)
        at = {}
        for i in range(len(ws) - 7):
            at.setdefault(tuple(ws[i : i + 8]), []).append(i)
        again = len({i + j for v in at.values() if len(v) > 1 for i in v for j in range(8)})
        failed = len(ws) < 20 or 100 * again > 30 * len(ws)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for w in ws for c in w), dup, again, failed)
        assert not (failed and r.kept)
    assert quality_rules.quality_rules(docs(spark, [])).count() == 0


def test_quality_rules(spark):
    prose = "\n".join(f"This is sentence number {i} about things that differ in word {i * 7}." for i in range(8))
    texts = [*ODD, prose, prose + "\nHome | About | Contact | Login | Help", "\n".join(["a | b | c | d"] * 3) + " " + " ".join(map(str, range(40)))]
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs(spark, texts)).collect()}
    assert [got[i].kept for i in range(len(ODD))] == [False] * len(ODD)
    a, b, c = (got[len(ODD) + i] for i in range(3))
    assert a.kept and a.clean_text == prose and b.kept and b.clean_text == prose and not c.kept
    rng = random.Random(2)
    for _ in range(200):
        w = rng.choices("abc", k=rng.randrange(40))
        at = {}
        for i in range(len(w) - 7):
            at.setdefault(tuple(w[i : i + 8]), []).append(i)
        want = {i + j for v in at.values() if len(v) > 1 for i in v for j in range(8)}
        assert quality_rules.repeated_words(w) == len(want)


def brute_spans(x):
    assign = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, m.end()) for m in re.finditer(assign, x) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 24])


def test_secrets_and_the_ledger(spark):
    rng = random.Random(4)
    bits = ["token", "Secret", "api_key", "=", ":", " ", '"', "abc", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", "🎼", "\n", "x=y"]
    texts = ODD + ["".join(rng.choices(bits, k=rng.randrange(30))) for _ in range(300)] + ["secret=token: abcdefgh", "-----BEGIN RSA PRIVATE KEY-----", "é token=abcdef1 " * 20_000]
    df = docs(spark, texts)
    found, kept, ledger = secret_scan.secret_scan(df, ["doc_id"])
    for r in found.collect():
        assert [(s.start, s.rank, s.end) for s in r.spans if s.base] == brute_spans(texts[r.doc_id] or "")
    kept, ledger = kept.cache(), ledger.cache()
    more = docs(spark, [*texts, "password = hunter22"])
    again, _, known = secret_scan.secret_scan(more, ["doc_id"], ledger=ledger, findings=kept)
    assert {r.doc_id: r.spans for r in again.collect() if r.doc_id < len(texts)} == {r.doc_id: r.spans for r in found.collect()}
    assert known.count() - ledger.count() == len(secret_scan.RULES)


def brute_dedup(rows, least):
    first, runs = {}, []
    for key, text in rows:
        lines = text.split("\n")
        n = [len(re.findall("[^\x20\x09-\x0d]+", x)) for x in lines]
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(n[a:b]) >= least:
                    runs.append((key, a, b, tuple(lines[a:b])))
    for key, a, _, run in runs:
        first[run] = min(first.get(run, (key, a)), (key, a))
    gone = {}
    for key, a, b, run in runs:
        if (key, a) > first[run]:
            gone.setdefault(key, set()).update(range(a, b))
    return {key: "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone.get(key, ())) for key, text in rows}


def test_line_runs(spark):
    rng = random.Random(6)
    pool = ["", "a b", "c d e", "f", "g h i j k", "l m"]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randrange(1, 14)))) for i in range(60)] + [(100, "a b\n" * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.line_dedup(df, min_words=6).collect()} == brute_dedup(rows, 6)


def test_line_dedup_of_odd_rows(spark):
    line = " ".join(f"w{i}" for i in range(60))
    rows = [(3, line), (None, line), (5, line), (5, line), (5, "other\n" + line), (6, None), (7, ""), (8, line + "\nend")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gone", F.lit(1)).withColumn("doc", F.lit("d"))
    got = [(r.doc_id, r.text, r.lines_removed) for r in line_dedup.line_dedup(df).collect()]
    assert sorted(got, key=str) == sorted([(3, "", 1), (None, line, 0), (5, "", 1), (5, "", 1), (5, "other", 1), (6, None, 0), (7, "", 0), (8, "end", 1)], key=str)
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def test_maximal_runs(spark):
    """Later copies merge to the longest stretch on which they agree with the first occurrence."""
    rng = random.Random(8)
    shared = [f"line {i} of it" for i in range(12)]
    rows = [(0, "\n".join(["start", *shared, "end"])), (1, "\n".join(["own a", *shared[2:9], "own b"])), (2, "\n".join(shared[:4] + ["cut"] + shared[6:])), (3, "\n".join(rng.sample(shared, 12)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    runs = line_dedup.maximal_runs(line_dedup.repeated_runs(df, min_words=12)).collect()
    assert sorted((r.doc, r.ln, r.n_lines, r.first.doc, r.first.ln) for r in runs) == [(1, 1, 7, 0, 3), (2, 0, 4, 0, 1), (2, 5, 6, 0, 7)]


def test_operators_of_empty_tables(spark):
    none = docs(spark, [])
    assert secret_scan.secret_scan(none, ["doc_id"])[0].count() == 0
    media = media_columns.media_columns(media_columns.text_media(none), "file", "declared")
    assert media_columns.media_features(media).count() == 0
