"""Operators that need no large table: exact round trips, brute force and edge cases."""

import base64
import hashlib
import random
import re
import time
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexiforge.llm import gif, html, licenses, mixing, packing, quality, toxicity, urls, warc
from lexiforge.llm.components import connected_components

TEXTS = [None, "", " \n\t", "a", "the " * 60, "é漢😀" * 50, "x" * 64, "word " * 3000, "a b c a b c\nline\nline\n"]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, blanks, repeats, long texts, and columns whose names clash with results."""
    rows = [(i, t, "n_words", None if i % 2 else f"s{i}") for i, t in enumerate([*TEXTS, "the same", "the same"])] + [(9, "the same", None, None), (None, "no id", None, "s1")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, source string").withColumn("kept", F.lit(1)).withColumn("size", F.lit("x")).repartition(3)


# --- quality -----------------------------------------------------------------------------------


def test_quality_counts(docs):
    for r in quality.quality_rules(docs).collect():
        words = [w for w in (r.text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
        windows = Counter(zip(words, words[1:], words[2:]))
        covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
        assert (r.n_words, r.n_repeat_words) == (len(words), len(covered))
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and not (r.base_failed and r.kept)
    one = quality.quality_rules(docs.where("doc_id = 8")).first()
    assert one.n_dup_lines == 1


def test_quality_of_an_empty_table(spark):
    assert quality.op6_quality_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_quality_against_duckdb(spark, sf, against_duckdb):
    against_duckdb(quality.op6_quality_rules(spark.read.parquet(f"{sf}/documents.parquet")), quality.oracle(), sf)


# --- GIF ---------------------------------------------------------------------------------------


def test_gif_query(docs):
    for r in gif.op1_gif(docs).collect():
        text = next((t for i, t in enumerate([*TEXTS, "the same", "the same"]) if i == r.doc_id), "no id") or ""
        payload = text.encode()
        full = payload + b"\0" * (max(64, -(-len(payload) // 64) * 64) - len(payload))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))


def test_gif_columns(docs):
    frames = gif.gif_frames(gif.encode_gifs(docs.where("doc_id = 7").select("doc_id", "text")).select("doc_id", "gif")).orderBy("frame_no").collect()
    assert b"".join(bytes(f.indices) for f in frames)[: len(TEXTS[7])] == TEXTS[7].encode()
    assert [f.start_ms for f in frames] == [gif.DELAY_MS * i for i in range(len(frames))] and all(sum(f.histogram) == f.width * f.height for f in frames)
    assert gif.frames_of(b"not a picture") is None and gif.frames_of(None) == []


def test_lzw_random_and_partial_streams():
    rng = random.Random(3)
    for n in (1, 2, 300, 9000, 50000):
        for letters in (range(256), b"ab", b"etaoin "):
            data = bytes(rng.choice(list(letters)) for _ in range(n))
            assert gif.lzw_decode(gif.pack_codes(*gif.lzw_codes(data)), 8, n) == data


def test_disposal_transparency_and_local_palettes():
    """Two-colour frames, written by hand: restore-to-background, restore-to-previous, a transparent index."""

    def frame(codes, disposal, transparent, left=0):
        packed = sum(c << (3 * i) for i, c in enumerate(codes)).to_bytes(4, "little")
        return b"!\xf9\x04" + bytes([disposal << 2 | (transparent >= 0), 5, 0, max(transparent, 0), 0]) + b"," + left.to_bytes(2, "little") + b"\0\0\x02\0\x01\0\0\x02" + gif.sub_blocks(packed)

    palette = bytes([0, 0, 0, 255, 255, 255, 255, 0, 0, 0, 0, 255])
    head = b"GIF89a\x02\0\x01\0\x81\0\0" + palette
    data = head + frame([4, 1, 2, 5], 1, -1) + frame([4, 0, 3, 5], 3, 0) + frame([4, 3, 0, 5], 2, 0) + frame([4, 0, 1, 5], 1, 0) + b";"
    frames = list(gif.read_gif(data, canvases=True))
    colours = [[f["canvas"][i : i + 4] for i in (0, 4)] for f in frames]
    white, red, blue, clear = b"\xff\xff\xff\xff", b"\xff\0\0\xff", b"\0\0\xff\xff", b"\0\0\0\0"
    assert colours == [[white, red], [white, blue], [blue, red], [clear, white]]
    assert [f["start_ms"] for f in frames] == [0, 50, 100, 150] and [sum(f["histogram"]) for f in frames] == [2, 1, 1, 1]


def plain_lzw_codes(data):
    """Codes by a dictionary of phrases, as a measure."""
    codes, known, phrase = [256], {bytes([i]): i for i in range(256)}, b""
    for i in range(len(data)):
        if (longer := phrase + data[i : i + 1]) in known:
            phrase = longer
            continue
        codes.append(known[phrase])
        if len(known) < gif.MAX_CODES - 2:
            known[longer] = len(known) + 2
        else:
            codes.append(256)
            known = {bytes([i]): i for i in range(256)}
        phrase = data[i : i + 1]
    return [*codes, *([known[phrase]] if phrase else []), 257]


def test_gif_codes_are_those_of_a_plain_encoder_and_a_round_trip_takes_little_longer(docs):
    payloads = [gif.padded((r.text or "").encode()) for r in docs.select("text").collect()] + [b"", b"ab" * 40_000, random.Random(3).randbytes(20_000)]

    def seconds(work):
        times = []
        for _ in range(3):
            began = time.process_time()
            found = [work(p) for p in payloads]
            times.append(time.process_time() - began)
        return min(times), found

    plain, codes = seconds(plain_lzw_codes)
    assert [gif.lzw_codes(p)[0].tolist() for p in payloads] == codes and not any(gif.PHRASES)
    payloads = [p for p in payloads if p]
    stored, frames = seconds(lambda p: list(gif.read_gif(gif.write_gif(p[: len(p) // 64 * 64]), canvases=True)))
    print("GIF seconds, plain encoder alone and round trip:", plain, stored)
    assert stored < 0.7 * plain


def test_gif_columns_hold_the_shown_pictures(spark):
    """A picture, then a transparent delta frame over its right half, after which the screen is cleared."""

    def frame(codes, disposal, transparent):
        packed = sum(c << (3 * i) for i, c in enumerate(codes)).to_bytes(4, "little")
        return b"!\xf9\x04" + bytes([disposal << 2 | (transparent >= 0), 5, 0, max(transparent, 0), 0]) + b",\0\0\0\0\x02\0\x01\0\0\x02" + gif.sub_blocks(packed)

    palette = bytes([0, 0, 0, 255, 255, 255, 255, 0, 0, 0, 0, 255])
    data = b"GIF89a\x02\0\x01\0\x81\0\0" + palette + frame([4, 1, 2, 5], 1, -1) + frame([4, 0, 3, 5], 2, 0) + frame([4, 0, 1, 5], 1, 0) + b";"
    rows = gif.gif_frames(spark.createDataFrame([(1, bytearray(data))], "doc_id long, gif binary")).orderBy("frame_no").collect()
    white, red, blue, clear = b"\xff\xff\xff\xff", b"\xff\0\0\xff", b"\0\0\xff\xff", b"\0\0\0\0"
    assert [bytes(r.canvas) for r in rows] == [white + red, white + blue, clear + white]
    assert all(bytes(r.palette) == palette and (r.screen_width, r.screen_height) == (2, 1) for r in rows)
    assert [{k: n for k, n in enumerate(r.colors) if n} for r in rows] == [{63: 1, 48: 1}, {63: 1, 3: 1}, {63: 1}]


# --- URLs --------------------------------------------------------------------------------------


def test_url_rules(spark):
    cases = {
        "http://WWW.Example.ORG/es/1": ("www.example.org", "/es/1", "example.org/es/", "block"),
        "https://example.org/en/19?x#y": ("example.org", "/en/19", "example.org/en/1", "block"),
        "https://a.org/": ("a.org", "/", "org/", "allow"),
        "https://a.org": ("a.org", "", None, None),
        "x://b.com/fr/?": ("b.com", "/fr/", "com/fr/", "allow"),
        "x://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "no scheme": ("", "", None, None),
        None: ("", "", None, None),
        "a://b://c/d": ("b:", "//c/d", None, None),
    }
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(cases)], "page_id long, url string, host string")
    for r in urls.url_filter(df, [0.0] * 9, threshold=0.5).orderBy("page_id").collect():
        host, path, rule, verdict = cases[r.url]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or "block")


def test_url_training_matches_plain_python(spark):
    labelled = urls.labelled_urls(spark, urls.BLOCKED[:12], urls.ALLOWED[:12])
    host, path = urls.parse_url(F.col("url"))
    rows = labelled.select("url", F.col("label").cast("double").alias("y"), urls.hashed_grams(host, path, 256).alias("x")).orderBy("url").collect()
    got = urls.train(labelled, steps=40, buckets=256)
    assert got == pytest.approx(urls.reference_weights([(r.x, r.y) for r in rows], steps=40, buckets=256))
    assert urls.train(labelled, steps=40, buckets=256) == got


def host_split():
    """The shipped labels, a quarter of the hosts held out by hash."""
    held = lambda u: zlib.crc32(u.split("/")[0].encode()) % 4 == 0
    return [[u for u in part if held(u) == out] for out in (False, True) for part in (urls.BLOCKED, urls.ALLOWED)]


def test_url_model_on_held_out_hosts(spark):
    bad, good, unseen_bad, unseen_good = host_split()
    rows = [(f"http://{u}", 1) for u in unseen_bad] + [(f"http://{u}", 0) for u in unseen_good]
    df = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(rows)], "page_id long, url string, y int")
    judged = urls.url_filter(df, urls.train(urls.labelled_urls(spark, bad, good)), rules=(), threshold=0.5)
    out = judged.collect()
    sure = [r.y for r in out if r.probability >= urls.THRESHOLD]
    assert 0 not in sure and len(sure) >= 0.2 * len(unseen_bad)
    caught = sum(r.y == 1 and r.verdict == "block" for r in out)
    wrong = sum(r.y == 0 and r.verdict == "block" for r in out)
    print("held out: caught", caught, "of", len(unseen_bad), "wrong", wrong, "of", len(unseen_good))
    assert caught >= 0.7 * len(unseen_bad) and wrong <= 0.2 * len(unseen_good)


def test_url_labels_share_shapes_of_paths():
    """Neither a top-level domain nor a path of a language and a number tells the kinds apart."""
    shape = re.compile(r"^[^/]+/(de|en|es|fr)/\d+$")
    counts = [sum(bool(shape.match(u)) for u in part) / len(part) for part in (urls.BLOCKED, urls.ALLOWED)]
    assert min(counts) > 0.1 and abs(counts[0] - counts[1]) < 0.05
    assert {u.split("/")[0].rsplit(".")[-1] for u in urls.BLOCKED} <= {u.split("/")[0].rsplit(".")[-1] for u in urls.ALLOWED}


def test_url_filter_edge_cases(spark):
    weights = [0.0] * 9
    df = spark.createDataFrame([(1, "http://" + "a" * 50_000 + ".com/" + "b" * 50_000), (1, "x://"), (None, None), (2, "x://b.com/fr/1"), (2, "x://b.com/fr/1")], "page_id long, url string").withColumn("rule", F.lit("clash"))
    out = urls.url_filter(df, weights).collect()
    assert len(out) == 5 and max(len(r.host) for r in out) == 50_004
    assert [r.verdict for r in out if r.page_id == 2] == ["allow", "allow"] and urls.op2_url_filter(df.limit(0)).count() == 0


# --- HTML --------------------------------------------------------------------------------------

PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li>Menu</li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><header><h1>Real &amp; true</h1></header><p>First   line<br>second</p><!-- gone --><p>Un<b>bro</b>ken&nbsp;x<div class="ad">Buy</div>
<form>Mail</form><section id="comments"><p>reader</p></section></article><aside>Side</aside><footer>&copy; me</footer></body></html>"""


def test_article_text(spark):
    rows = [(1, "http://a/1", PAGE), (2, None, None), (3, "http://a/2", ""), (4, "bad url", "plain &lt;text&gt;"), (5, "http://b/1", "<p>a<p>b</div><p>c"), (1, "http://a/1", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html.op4_html_text(df).collect())
    want = "Real & true\nFirst line\nsecond\nUnbroken x"
    assert got == [(1, want, len(want)), (1, want, len(want)), (2, "", 0), (3, "", 0), (4, "plain <text>", 12), (5, "a\nb\nc", 5)]
    assert html.op4_html_text(df.limit(0)).count() == 0


def test_differencing_does_not_depend_on_blocks(spark):
    rows = [(i, f"http://h{i % 2}.test/{i % 7}/{i}", f"<body><p>menu</p><p>own {i} with some words of its own</p><p>foot {i % 2}</p></body>") for i in range(60)]
    rows += [(100 + i, "http://h0.test/x", "<p>copy of a page</p><p>menu</p>") for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    one = sorted(map(tuple, html.extract_main_text(df, 1).collect()))
    assert one == sorted(map(tuple, html.extract_main_text(df, 40).collect()))
    assert all(r[2] == f"own {r[0]} with some words of its own" for r in one if r[0] < 60)
    assert all(r[2].startswith("copy of a page") for r in one if r[0] >= 100)


def test_common_lines_is_longest():
    rng = random.Random(5)

    def longest(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(10))] for _ in range(2))
        pairs = html.common_lines(a, b)
        assert len(pairs) == longest(a, b) and pairs == sorted(pairs) and all(a[i] == b[j] for i, j in pairs)


# --- licenses ----------------------------------------------------------------------------------


def test_license_scan(spark):
    mit = licenses.TEMPLATES["mit"]
    changed = mit.replace("free of charge, ", "").replace("copies of the Software, and", "any copies of the Software and")
    rows = [(1, f"Intro. {mit} End."), (2, changed.upper()), (3, "Released under the\nMIT license."), (4, "Permission to land is granted."), (5, None), (6, ""), (7, "x Licensed under CC BY-NC 4.0. y " * 2)]
    found = licenses.op3_license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.template) for r in sorted(found)] == [(1, "mit"), (2, "mit"), (3, "mit-line"), (7, "cc-by-nc-4.0-line"), (7, "cc-by-nc-4.0-line")]
    full = next(r for r in found if r.doc_id == 1)
    assert full.coverage == 1.0 and rows[0][1][full.start : full.end] == mit.rstrip(".")
    assert 0.9 < next(r for r in found if r.doc_id == 2).coverage < 1


def test_license_scan_short_templates_and_edges(spark):
    schema = "doc_id long, text string, template string, start long"
    rows = [(1, "Dual: CC0 CC0, or Zero Clause.", "x", 9), (1, "Dual: CC0 CC0, or Zero Clause.", "x", 9), (2, "no cc 0", None, None), (3, "w " * 200_000 + "zero clause", None, None)]
    templates = spark.createDataFrame([("cc0", "CC0"), ("zero", "Zero Clause"), ("none", "..."), ("null", None)], "template string, text string")
    found = [(r.doc_id, r.template, r.start, r.end) for r in licenses.license_scan(spark.createDataFrame(rows, schema), templates).collect()]
    once = [(1, "cc0", 6, 9), (1, "cc0", 10, 13), (1, "zero", 18, 29)]
    assert sorted(found) == sorted([*once, *once, (3, "zero", 400_000, 400_011)])
    assert licenses.op3_license_scan(spark.createDataFrame([], schema)).count() == 0


def test_license_alignment_against_brute_force():
    """Edited templates among other words: the matched words are the longest common subsequence with the whole text."""

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rng, seen = random.Random(5), 0
    for _ in range(300):
        template = [f"t{rng.randrange(40)}" for _ in range(rng.randrange(12, 40))]
        edited, indels, run, longest = [], 0, 0, 0
        for w in template:
            kind = rng.random()
            if kind < 0.04 and indels < len(template) // 3:
                indels, run = indels + 1, 0
                continue
            if kind < 0.08 and indels < len(template) // 3:
                indels, run = indels + 1, 0
                edited.append("extra")
            elif kind < 0.12:
                run = 0
                edited.append("changed")
                continue
            edited.append(w)
            run += 1
            longest = max(longest, run)
        text = " ".join([f"n{rng.randrange(50)}" for _ in range(rng.randrange(30))] + edited + [f"n{rng.randrange(50)}" for _ in range(rng.randrange(30))])
        best = lcs(template, text.split())
        found = licenses.scan(text, licenses.build_index({"t": " ".join(template)}))
        assert all(n <= best for _, _, n, *_ in found)
        if longest >= licenses.GRAM + licenses.WINDOW - 1 and best >= licenses.MIN_COVERAGE * len(template):
            seen += 1
            assert max(n for _, _, n, *_ in found) == best
    assert seen > 100


# --- WARC --------------------------------------------------------------------------------------


def test_warc_archive(spark, tmp_path):
    rows = [(1, "http://a/1", "same"), (2, "http://a/2\r\nX: y", "same"), (5, None, "same"), (3, "http://b", "Ünique"), (4, "http://c", None), (6, "http://d", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.op8_warc(df).collect()}
    for page, _, text in rows:
        body = (text or "").encode()
        owner = max(p for p, _, t in rows if (t or "") == (text or ""))
        r = got[page]
        assert r.verified and r.payload_bytes == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if page == owner else ("revisit", owner))
    folder = str(tmp_path / "archive")
    warc.write_archive(df, folder)
    assert spark.read.parquet(f"{folder}/payloads").count() == 3
    records = {r.page_id: bytes(r.record) for r in warc.read_records(spark, folder).collect()}
    assert records[3].startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and records[3].endswith(b"\r\n\r\n" + "Ünique".encode() + b"\r\n\r\n")
    assert b"Content-Length: 0\r\n" in records[1] and b"\r\nX: y" not in records[2]
    assert warc.op8_warc(df.limit(0)).count() == 0


def test_warc_rows_without_a_number_and_changed_payloads(spark, tmp_path):
    rows = [(None, "http://a", "only here"), (None, "http://b", "only here"), (None, "http://c", "shared"), (7, "http://d", "shared"), (8, "http://e", "alone")]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, digest string, owner string")
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0, r.verified) for r in warc.op8_warc(df).collect())
    assert got == [(0, 6, "revisit", 7, True), (0, 9, "response", 0, True), (0, 9, "response", 0, True), (7, 6, "response", 0, True), (8, 5, "response", 0, True)]
    folder = str(tmp_path / "archive")
    warc.write_archive(df, folder)
    assert sum(b"only here" in bytes(r.record) for r in warc.read_records(spark, folder).collect()) == 2
    spark.read.parquet(f"{folder}/payloads").withColumn("payload", F.when(F.octet_length("payload") == 5, F.lit(b"other")).otherwise(F.col("payload"))).write.parquet(f"{folder}/changed")
    (tmp_path / "archive" / "payloads").rename(tmp_path / "archive" / "old")
    (tmp_path / "archive" / "changed").rename(tmp_path / "archive" / "payloads")
    assert [r.page_id for r in warc.read_archive(spark, folder).where("not verified").collect()] == [8]
    with pytest.raises(Exception, match="payload is not the one"):
        warc.read_records(spark, folder).collect()


def test_html_differences_pages_with_and_without_an_article():
    page = lambda *lines: ([t for t, _ in lines], [f for _, f in lines])
    menu, footer = [(f"Menu entry {i}", False) for i in range(40)], [("Imprint and contact", False)]
    long = "This paragraph is quoted by two articles of the site, and it is long enough to be content in both of them."
    # a large shared menu around short texts, without an article element
    one, two = page(*menu, ("A short note.", False), *footer), page(*menu, ("Another one.", False), *footer)
    assert html.keep_lines(one, two, None) == ["A short note."]
    # shared labels inside articles go, shared paragraphs and copied articles stay
    a = page(*menu, ("Share this", True), (long, True), ("The first article says a thing that no other article says, at length.", True))
    c = page(*menu, ("Share this", True), (long, True), ("x" * 300, True))
    assert html.keep_lines(c, a, None) == [long, "x" * 300]
    copy = page(("Elsewhere", False), ("Share this", True), (long, True))
    assert html.keep_lines(copy, a, None) == ["Share this", long]
    # an article teaser does not hide a main text outside it; menus are shared
    own = ["The main text of this page stands outside the article element, and it is a good deal longer.", "Short own line"]
    teaser = page(*menu, ("Read on", True), *[(t, False) for t in own])
    assert html.keep_lines(teaser, a, None) == ["Read on", *own]


def test_html_keeps_wrappers_of_the_article():
    text = lambda page: [t for t, _ in html.block_lines(page)]
    assert text("<div class='layout has-sidebar'><h1>T</h1><article><p>Body</p></article></div><div class='sidebar'>no</div>") == ["T", "Body"]
    assert text("<div class='with-comments'><main>Body</main><div class='comments'>no</div></div>") == ["Body"]
    assert text("<article>Body</article><div class='comments'><article>no</article></div>") == ["Body"]
    assert text("<nav class='menu'><article>no</article></nav><p>Body</p>") == ["Body"]


# --- mixing ------------------------------------------------------------------------------------


def by_hand(sizes, weights):
    """Water filling by repetition."""
    total, free = sum(sizes), set(range(len(sizes)))
    while True:
        rest, w = total - sum(3 * sizes[i] for i in range(len(sizes)) if i not in free), sum(weights[i] for i in free)
        over = [i for i in free if rest * weights[i] / w > 3 * sizes[i]]
        if not over:
            return [rest * weights[i] / w if i in free else 3.0 * sizes[i] for i in range(len(sizes))]
        free -= set(over)


@pytest.mark.parametrize("sizes", [[10, 1000, 10, 5], [0, 0], [7], [1, 1, 1, 1, 90000, 3], [100, 100, 100, 0]])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(f"s{i}" if i else None, v) for i, v in enumerate(sizes)], "source string, source_size long")
    got = [r.target for r in mixing.targets(df).orderBy("position").collect()]
    order = [*range(1, len(sizes)), 0]  # null comes last
    want = by_hand([sizes[i] for i in order], [(5, 2, 1)[k % 3] for k in range(len(sizes))]) if sum(sizes) else [0.0] * len(sizes)
    assert got == pytest.approx(want)


def test_mix(spark, docs):
    out = mixing.op5_mixing(docs)
    assert out.count() == docs.count() and all(0 <= r.taken <= 3 * r["size"] for r in out.collect())
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 7, "big").when(F.col("id") % 10 < 9, "mid").alias("source"), F.repeat(F.lit("w "), (F.col("id") % 37 + 1).cast("int")).alias("text"))
    first = mixing.op5_mixing(many)
    for r in first.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 40
    assert sorted(map(str, first.collect())) == sorted(map(str, mixing.op5_mixing(many.repartition(7)).collect()))
    light = mixing.sized(many)
    quotas = mixing.draw_quotas(light)
    mixed = mixing.mix(light, quotas, shard_words=5000)
    want = mixing.with_copies(light, quotas).agg(F.sum("copies")).first()[0]
    assert mixed.count() == want and mixed.select("doc_id", "copy").distinct().count() == want
    assert mixing.op5_mixing(many.limit(0)).count() == 0


def test_op5_deals_its_copies_to_several_shards(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 7, "big").when(F.col("id") % 10 < 9, "mid").alias("source"), F.repeat(F.lit("w "), (F.col("id") % 37).cast("int")).alias("text"))
    rows = mixing.op5_mixing(docs.union(docs.where("doc_id < 5"))).collect()
    assert len(rows) == 3005 and all(len(r.shard) == len(r.turn) == r.copies for r in rows)
    light = mixing.sized(docs)
    quotas = mixing.draw_quotas(light)
    want = {r.doc_id: r.copies for r in mixing.with_copies(light, quotas).collect()}
    one = {r.doc_id: r for r in mixing.op5_mixing(docs).collect()}
    assert {i: r.copies for i, r in one.items()} == want
    dealt = Counter((i, s, t) for i, r in one.items() for s, t in zip(r.shard, r.turn, strict=True))
    assert dealt == Counter((r.doc_id, r.shard, r.turn) for r in mixing.mix(light, quotas).collect())
    per_shard = Counter(s for _, s, _ in dealt)
    assert sorted(per_shard) == list(range(mixing.MIN_SHARDS)) and max(per_shard.values()) < 2 * min(per_shard.values())


def test_many_sources_are_joined_without_broadcasts(spark, monkeypatch):
    rows = [(i, f"s{i % 40}" if i % 40 else None, (i * 7) % 50, "clash", "clash") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long, copy string, shard string")
    quotas = mixing.draw_quotas(docs)
    want = sorted(map(tuple, mixing.mix(docs, quotas).collect()))
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 3)
    assert [q.runs for q in mixing.draw_quotas(docs)] == [q.runs for q in quotas]
    assert sorted(map(tuple, mixing.mix(docs, quotas).collect())) == want


def test_last_pass_goes_on_behind_documents_that_do_not_fit(spark):
    u = mixing.place() / F.lit(1 << mixing.HASH_BITS)
    at = spark.range(10_000, 11_000).select(F.col("id").alias("doc_id"), F.lit(60_000).cast("long").alias("size"))
    long_one = at.where((u > 0.28) & (u < 0.32)).orderBy("doc_id").first().doc_id
    rows = [(i, "b", 100) for i in range(1000)] + [(long_one, "b", 60_000)] + [(i, "a", 100) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    quotas = mixing.draw_quotas(docs)
    taken = mixing.with_copies(docs, quotas).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("n"))
    assert {q.source: q.target for q in quotas} == pytest.approx({"a": 200_000, "b": 80_000})
    assert {r.source: r.n for r in taken.collect()} == {"a": 200_000, "b": 80_000}


def test_last_pass_is_first_fit_in_hash_order(spark):
    rng = random.Random(3)
    rows = [(i, "ab"[i % 3 > 0], int(rng.paretovariate(0.7)) * 3 % 5000) for i in range(400)]
    rows += [r for r in rows if r[0] % 5 == 0] * 2  # repeated rows are taken together
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    light = docs.withColumn("u", mixing.place())
    quotas = mixing.draw_quotas(docs)
    want = Counter()
    for q in quotas:
        units = Counter()
        for r in light.where(F.col("source") == q.source).collect():
            units[r.u] += r["size"]
        missing = round(q.target) - q.passes * q.source_size
        want[q.source] = q.passes * q.source_size
        for n in (units[k] for k in sorted(units)):
            if n <= missing:
                missing, want[q.source] = missing - n, want[q.source] + n
    got = mixing.with_copies(docs, quotas).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("n"))
    assert {r.source: r.n for r in got.collect()} == dict(want)


def test_splitting_tree_is_exact():
    counts = [70, 0, 31, 256]
    paths = [mixing.split_path(counts, 13, k, 3) for k in range(13)]
    assert [sum(p[i][1] for p in paths) for i in range(4)] == counts
    assert max(sum(n for _, n in p) for p in paths) - min(sum(n for _, n in p) for p in paths) <= 1
    for i in range(4):
        taken = [t for p in paths for t in range(p[i][0], p[i][0] + p[i][1])]
        assert sorted(taken) == list(range(counts[i]))
    assert all(sorted(mixing.permuted(b, n, 12345) for b in range(n)) == list(range(n)) for n in (1, 2, 7, 256))


def test_every_shard_gets_several_blocks():
    """However many shards: sixteen as in small corpora, and ten thousand with sources of very unequal shares."""
    assert mixing.blocks_for(16) == mixing.N_BLOCKS
    for shards in (16, 10_000):
        n = mixing.blocks_for(shards)
        assert n & (n - 1) == 0
        counts = [3 * n, n, n + n // 3, n // 50]
        for shard in {0, 1, shards // 3, shards - 1}:
            assert sum(k for _, k in mixing.split_path(counts, shards, shard, 5)) >= mixing.BLOCKS_A_SHARD


# --- packing -----------------------------------------------------------------------------------


def test_plans_are_gapless_and_complete():
    rng = random.Random(8)
    for _ in range(150):
        histogram = {rng.randrange(1, 101): rng.randrange(0, 40) for _ in range(rng.randrange(0, 60))}
        bins, placed = {}, Counter()
        for length, rank, count, first, offset in packing.plan(histogram, 100):
            assert rank == placed[length]
            placed[length] += count
            for i in range(count):
                bins.setdefault(first + i, []).append((offset, length))
        assert placed == {n: c for n, c in histogram.items() if c}
        for items in bins.values():
            end = 0
            for offset, length in sorted(items):
                assert offset == end
                end += length
            assert end <= 100
            assert sum(3 * n > 100 for _, n in items) <= 2


def test_packing_query(docs):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    rows = packing.op10_packing(docs).collect()
    want = Counter()
    for r in docs.collect():
        ids = np.array([*encoder.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want.update((r.doc_id, k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    ends = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 2048
    sequences = packing.pack_sequences(docs).collect()
    assert sum(r.n_tokens for r in sequences) == sum(ends.values()) and all(len(r.ids) == r.n_tokens for r in sequences)
    assert packing.op10_packing(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["it's don't 'S x's CAN'T. we'll,", "a<|endoftext|>b <|endoftext|> c", "Ça É́ İstanbul ΣΑΣ x\xa0y", "foo.bar, baz.!? --", "日本語 テスト", "a\x1cb z\u200b", "ǅ ß ﬁ e\u0301. e\u0301", "Of%%% the*** #1 2nd"])
def test_words_encode_as_texts(text):
    ids = packing.Ids(packing.TOKENIZER)
    assert ids.of([text])[0].tolist() == [*ids.encoder.encode(text, add_special_tokens=False).ids, 0]


# --- components --------------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2001 + i) for i in range(50)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root}


def test_components_of_more_edges_than_a_task_takes_and_few_shuffles_for_few(spark, monkeypatch):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 300) if i % 50] + [(1000, 1001 + i) for i in range(70)], "u long, v long").repartition(6)
    want = {i: max(1, i // 50 * 50 + 1) for i in range(1, 301) if i % 50} | {i: (i - 50) // 50 * 50 + 1 for i in range(50, 301, 50)} | {1000 + i: 1000 for i in range(71)}
    one_task = connected_components(edges)
    assert {r.node: r.component for r in one_task.collect()} == want
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup
    spark.sparkContext.setJobGroup("few edges", "")
    connected_components(edges)
    few = len(jobs("few edges"))
    spark.sparkContext.setJobGroup("many edges", "")
    monkeypatch.setattr("lexiforge.llm.components.TASK_EDGES", 40)
    many = connected_components(edges)
    assert few <= 5 < len(jobs("many edges"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r.node: r.component for r in many.collect()} == want


# --- toxicity ----------------------------------------------------------------------------------


def test_kernel_tolerates_inserted_characters():
    plain = "there inner other reading stand thing letter water horse garden window paper simple little morning".split()
    rng = random.Random(2)
    sentences = [(" ".join(sorted(rng.sample(plain, 5))), 0, None) for _ in range(200)]
    sentences += [(" ".join(sorted([*rng.sample(plain, 4), bad])), 1, i) for i in range(60) for bad in ("idiot", "worthless", "disgusting")]
    model = toxicity.train_sentences(sentences, 24)
    words = ["idiot", "i.d.i.o.t", "idi0t", "iddiiot", "worth-less", "disgusstingg", "inner", "reader", "watering", ""]
    margins = dict(zip(words, model.margins([["garden", "horse", "letter", "water", w] for w in words]).tolist(), strict=True))
    assert all(margins[w] > 0 for w in words[:6]) and all(margins[w] < 0 for w in words[6:])
    assert "idiot" in toxicity.word_list("you i d i o t there") and toxicity.word_list("") == []
    assert toxicity.train_sentences([("a b", 1, 1)]) is None


def test_kernel_is_the_subsequence_kernel():
    """Against plain Python: all letter triples in order with bounded gaps, unit length, to the power."""
    def table(word):
        marked, out = "<" + word + ">", Counter()
        for i, a in enumerate(marked):
            for one in range(1, toxicity.MAX_STEP + 1):
                for two in range(1, toxicity.MAX_STEP + 1):
                    if i + one + two < len(marked):
                        out[a, marked[i + one], marked[i + one + two]] += toxicity.DECAY ** (one + two - 2)
        return out

    def plain(x, y):
        a, b = table(x), table(y)
        return (sum(v * b[k] for k, v in a.items()) / (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5) ** toxicity.POWER

    words, marks = ["idiot", "idiom", "window", "xyz", "a", "idiotic"], ["idiot", "window"]
    got = toxicity.Landmarks(marks).kernel(words)
    table_of = {w: [sum(1 for _ in table(w))] for w in words}
    assert all(table_of[w] for w in words)

    def weights(word):  # repeated triples of a word are separate terms of its norm in the vectorised form
        owner, code, weight = toxicity.triples([word])
        return Counter({c: float(weight[code == c].sum()) for c in set(code.tolist())})

    for i, w in enumerate(words):
        for j, m in enumerate(marks):
            a, b = weights(w), weights(m)
            assert got[i, j] == pytest.approx(sum(v * b[k] for k, v in a.items()) ** toxicity.POWER, abs=1e-5)
            if len(set(w)) == len(w) and len(set(m)) == len(m):
                assert got[i, j] == pytest.approx(plain(w, m), abs=1e-5)


def test_the_kernel_takes_little_longer_than_the_triples_and_signs_make_no_difference():
    rng = random.Random(8)
    syllables = "ther inne ent re stan lett wat hor gar win pap sim lit mor ing ed".split()
    plain = ["".join(rng.choices(syllables, k=rng.randrange(1, 5))) for _ in range(8000)]
    words, marks = plain + [w + rng.choice(",.;!") for w in plain], toxicity.Landmarks(sorted(set(plain))[:: len(set(plain)) // 128][:128])
    seconds = lambda work: min(-time.process_time() + (work() is None) + time.process_time() for _ in range(3))
    alone, whole = seconds(lambda: toxicity.triples(words)), seconds(lambda: marks.kernel(words))
    print("kernel seconds, triples alone and whole:", alone, whole)
    got = marks.kernel(words)
    assert (got[:8000] == got[8000:]).all() and (marks.kernel(plain[:50]) == got[:50]).all()
    assert whole < 3.5 * alone
    signs = ["", "|", "a.", 'a!\'")', "…’", "a.b", "?)x", toxicity.BREAK]
    assert [toxicity.is_last(w) for w in signs] == [w == toxicity.BREAK or toxicity.LAST.search(w) is not None for w in signs]


def test_scoring_equals_sentence_by_sentence(spark):
    sentences = [("a garden grows", 0, None), ("the horse runs", 0, None), ("you idiot", 1, 1), ("moron there", 1, 2)] * 3
    model = toxicity.train_sentences(sentences, 8)
    texts = [None, "", " \n ", "...", "You idiot. The horse runs! a | b", "word " * 3000 + "moron", "x" * 5000, "i d i o t", "idiot " * 40, "you\nidiot\n"]
    got = toxicity.Scorer(model).of(texts)
    for text, evidence in zip(texts, got, strict=True):
        words = toxicity.word_list(text or "")
        starts = toxicity.runs(toxicity.np.array([w == toxicity.BREAK or bool(toxicity.LAST.search(w)) for w in words], dtype=bool)).tolist()
        margins = [min(max(float(model.margins([sorted(set(words[a:b]))])[0]), toxicity.FLOOR), -toxicity.FLOOR) for a, b in zip(starts, [*starts[1:], len(words)])]
        want = sorted(margins, reverse=True)[: toxicity.EVIDENCE]
        assert evidence == pytest.approx(want + [toxicity.FLOOR] * (toxicity.EVIDENCE - len(want)), abs=1e-5)
    assert all(max(map(len, toxicity.word_list("y" * 1000 + " z"))) <= toxicity.LONG_WORD for _ in range(1))
    assert [len(p) for p in toxicity.bounded(["abc"] * 5, 6)] == [2, 2, 1] and list(toxicity.bounded(["abcdefghi"], 6)) == [["abcdefghi"]]


def test_toxicity_query(spark, docs):
    rows = [(1000 + i, f"some clean words about tree number{i} and river. the garden is green", 0) for i in range(120)] + [(3000 + i, f"some words about number{i}. you are an idiot and a clown near house{i}x", 1) for i in range(60)]
    data = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = toxicity.op7_toxicity(data.select("doc_id", "text").union(docs.select("doc_id", "text")), data.select("doc_id", "toxic"))
    truth = {r[0]: r[2] for r in rows}
    for r in out.collect():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if r.doc_id in truth:
            assert r.predicted == truth[r.doc_id]
    none = toxicity.op7_toxicity(docs, data.select("doc_id", "toxic").limit(0))
    assert {r.predicted for r in none.collect()} == {0}
    assert toxicity.op7_toxicity(docs.limit(0), data.select("doc_id", "toxic")).count() == 0
    both = toxicity.score(data.select("doc_id", "text", F.lit("x").alias("score"), F.lit("y").alias("evidence")), toxicity.Model(None))
    assert sorted(both.columns) == ["doc_id", "predicted", "score", "text"]
