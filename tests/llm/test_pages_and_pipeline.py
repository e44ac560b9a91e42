"""WARC archives, HTML extraction and the pipeline."""

import base64
import gzip
import hashlib
import os
import random
import struct
import tempfile
import zipfile

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scour.llm import html_extract, warc_zip
from scour.llm.components import components
from tests.conftest import SF_SMALL


# --------------------------------------------------------------------------- WARC

PAGES = [(5, "http://a/", "<p>one</p>"), (3, "http://b/", "<p>one</p>"), (9, None, "é ñ"),
         (10, "http://c/\r\nX: y", ""), (11, "u", None), (12, "u", "x" * 200_000),
         (3, "http://b/", "<p>one</p>"), (None, "u", "<p>one</p>"), (13, "u", "\r\n\r\nWARC/1.1\r\n")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2) \
        .withColumn("digest", F.lit("clash")).withColumn("path", F.lit(1))


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, least):
    got = warc_zip.round_trip(spark, frame(spark, PAGES), least).collect()
    first = {}
    for p, _, h in PAGES:
        b = (h or "").encode()
        if p is not None and len(b) >= least:
            first[b] = min(first.get(b, p), p)
    want = []
    for p, _, h in PAGES:
        b = (h or "").encode()
        refers = first.get(b, p) if p is not None else None
        again = p is not None and refers != p
        want.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(),
                     "revisit" if again else "response", refers if again else None))
    key = lambda r: str(r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    assert warc_zip.round_trip(spark, frame(spark, PAGES).limit(0)).count() == 0


def test_warc_payloads_come_back_whole(spark):
    files = warc_zip.write_archives(frame(spark, PAGES), tempfile.mkdtemp(), min_revisit_bytes=1 << 40)
    got = warc_zip.read_archives(files).collect()
    assert sorted(bytes(r["payload"]) for r in got) == sorted((h or "").encode() for _, _, h in PAGES)
    assert {r["url"] for r in got} == {"http://a/", "http://b/", "", "http://c/%0D%0AX: y", "u"}
    for r in files.collect():                             # any ZIP reader can open them
        with zipfile.ZipFile(r["path"]) as z:
            assert z.testzip() is None and warc_zip.WARC_MEMBER in z.namelist()


def records(n=5):
    return [warc_zip.record(i, "u", b"x" * i, warc_zip.base32_sha1(b"x" * i), None) for i in range(n)]


def test_zip64_directory_and_missing_index():
    data = b"".join(records())
    path = os.path.join(tempfile.mkdtemp(), "a.wacz")
    name = b"archive/data.warc"
    extra = struct.pack("<HHQQ", 1, 16, len(data), len(data))
    local = warc_zip.LOCAL + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, 0, 2 ** 32 - 1, 2 ** 32 - 1,
                                         len(name), len(extra)) + name + extra
    pad = b"junk before the archive"
    body = pad + local + data
    extra = struct.pack("<HHHHQQQ", 0x9999, 0, 1, 24, len(data), len(data), len(pad))
    entry = warc_zip.ENTRY + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, 2 ** 32 - 1,
                                         2 ** 32 - 1, len(name), len(extra), 2, 0, 0, 0,
                                         2 ** 32 - 1) + name + extra + b"hi"
    end64 = warc_zip.END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(entry), len(body))
    locator = warc_zip.LOCATOR64 + struct.pack("<IQI", 0, len(body) + len(entry), 1)
    end = warc_zip.END + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 2 ** 32 - 1, 2 ** 32 - 1, 4) + b"note"
    with open(path, "wb") as f:
        f.write(body + entry + end64 + locator + end)
    spots = list(warc_zip.ranges_of(path))
    with open(path, "rb") as f:
        whole = f.read()
    assert [whole[o:o + n] for _, o, n in spots] == records()


def foreign(kind, url, body, digest=True):
    """A record as another writer makes it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" if kind == "response" else b""
    named = f"WARC-Payload-Digest: sha1:{warc_zip.base32_sha1(body)}\r\n" if digest else ""
    head = (f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{url}>\r\n"
            f"WARC-Target-URI: http://h/{url}\r\n{named}Content-Length: {len(http + body)}\r\n\r\n")
    return head.encode() + http + body + b"\r\n\r\n"


def package(members):
    path = os.path.join(tempfile.mkdtemp(), "other.wacz")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        for name, data in members:
            z.writestr(name, data)
    return path


def cdxj(name, parts, keep=lambda i: True):
    at, lines = 0, [b'!meta 0 {"format": "cdxj-gzip"}\n']
    for i, p in enumerate(parts):
        if keep(i):
            lines.append(f'com,h)/{i} 20200101 {{"url": "u", "filename": "{name}", "offset": "{at}", '
                         f'"length": "{len(p)}"}}\n'.encode())
        at += len(p)
    return b"".join(lines)


@pytest.mark.parametrize("indexed", ["plain", "gzip", "none"])
def test_foreign_packages_with_several_members(spark, indexed):
    bodies = [bytes([65 + i]) * (i * 50_000) for i in range(6)]
    plain = [foreign("response", f"p{i}", b, digest=i % 2 == 0) for i, b in enumerate(bodies)]
    packed = [gzip.compress(foreign("response", f"z{i}", b)) for i, b in enumerate(bodies)]
    info = gzip.compress(foreign("warcinfo", "info", b"software: x", digest=False))
    members = [("archive/a.warc", b"".join(plain)), ("archive/b.warc.gz", b"".join(packed)),
               ("archive/c.warc.gz", info)]
    if indexed == "plain":
        members += [("indexes/a.cdxj", cdxj("a.warc", plain)), ("indexes/b.cdxj", cdxj("b.warc.gz", packed))]
    if indexed == "gzip":
        lines = cdxj("a.warc", plain) + cdxj("archive/b.warc.gz", packed)
        members += [("indexes/index.cdx.gz", gzip.compress(lines[:300]) + gzip.compress(lines[300:]))]
    files = spark.createDataFrame([(package(members),)], "path string")
    got = {r.url: (r.record_type, r.payload_bytes, bytes(r.payload), r.payload_digest)
           for r in warc_zip.read_archives(files).collect()}
    want = {f"http://h/{c}{i}": ("response", len(b), b, warc_zip.base32_sha1(b))
            for c in "pz" for i, b in enumerate(bodies)}
    want["http://h/info"] = ("warcinfo", 11, b"software: x", warc_zip.base32_sha1(b"software: x"))
    assert got == want


def test_foreign_packages_that_cannot_be_read_raise():
    one = foreign("response", "p", b"x")
    path = os.path.join(tempfile.mkdtemp(), "deflated.wacz")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/a.warc.gz", gzip.compress(one))
    with pytest.raises(ValueError, match="compressed"):
        list(warc_zip.ranges_of(path))
    lost = package([("archive/a.warc", one), ("archive/b.warc", one),
                    ("indexes/i.cdxj", b'{"offset": 0, "length": 5}')])
    with pytest.raises(ValueError, match="no member"):
        list(warc_zip.ranges_of(lost))
    cut = package([("archive/a.warc.gz", gzip.compress(one)[:-9])])
    with pytest.raises(ValueError, match="cut short"):
        list(warc_zip.ranges_of(cut))
    with pytest.raises(ValueError, match="digest"):
        warc_zip.parse(foreign("response", "p", b"xyz").replace(b"xyz", b"xyy"))


def test_broken_archives_and_payloads_are_errors():
    good = records()[3]
    with pytest.raises(ValueError):
        warc_zip.parse(good.replace(b"xxx\r\n", b"xyx\r\n"))
    path = os.path.join(tempfile.mkdtemp(), "a.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/data.warc", b"".join(records()))
    with pytest.raises(ValueError):
        list(warc_zip.ranges_of(path))
    with open(path, "wb") as f:
        f.write(b"no archive")
    with pytest.raises(ValueError):
        list(warc_zip.ranges_of(path))


# --------------------------------------------------------------------------- HTML

PRIOR = html_extract.weights_from({})


def test_region_equals_brute_force():
    rnd = random.Random(4)
    for _ in range(300):
        s = [rnd.choice([-3, -1, -0.5, 0, 0.5, 1, 4]) for _ in range(rnd.randint(0, 25))]
        sums = [sum(s[a:b]) for a in range(len(s)) for b in range(a + 1, len(s) + 1)]
        a, b = html_extract.best_region(s)
        assert sum(s[a:b]) == max([0, *sums])


@pytest.mark.parametrize("page, want", [
    ("", ""), ("plain words only", "plain words only"), ("<p>a", "a"), ("<script>x", ""),
    ("<script>var t='</p>';if(a<b)f()</script><style>p{}</style><p>One  &amp;\n two</p>", "One & two"),
    ("<body><nav><a>Home</a></nav><article><h1>Title</h1><p>First <b>bold</b> one.<p>Second<br>line"
     "<div class='ad'>Buy</div><p>End.</article><footer>&copy; x</footer>", "Title\nFirst bold one.\nSecond line\nEnd."),
    ("<div id=top-menu><a>Home</a> <a>About</a></div><div class=post><h2>T</h2><p>Body of the text here.</p>"
     "<ul><li>item one is here<li>two</ul></div><div class='comments'><p>Nice post, I like it a lot</p></div>",
     "T\nBody of the text here.\nitem one is here\ntwo"),
    ("<div class='cookie-notice'>We use cookies to make this site better for you</div><form><p>Your name</p>"
     "</form><aside>Related</aside><main><header><h1>Head</h1></header><p>Text&#33; 1 &lt; 2</p></main>", "Text! 1 < 2"),
    ("<!-- <p>no</p> --><p title='a > b'>yes</p>", "yes"), ("<p>a<nav>b<p>c</nav>d</p>", "a\nd"),
])
def test_extract_cases(page, want):
    assert html_extract.extract_text(page, PRIOR) == want


BODY = "<p>The text of the article is here.</p>"


@pytest.mark.parametrize("page, want", [
    (f"<article style='overflow:hidden'>{BODY}</article>", True),
    (f"<article aria-hidden=false>{BODY}</article>", True),
    (f"<article aria-hidden='true'>{BODY}</article>", False),
    (f"<article hidden>{BODY}</article>", False), (f"<article hidden=''>{BODY}</article>", False),
    (f"<article data-id='widget-7' data-class=ad title='id=menu hidden'>{BODY}</article>", True),
    (f"<div class='content has-sidebar'><ul><li class=widget>one<li>two</ul><article>{BODY}</article></div>", True),
    (f"<form id=aspnetForm><article>{BODY}</article></form>", True),
    (f"<object><div><main>{BODY}</main></div></object>", True),
    (f"<form class=search><input><p>find something here</p></form><article>{BODY}</article>", True),
    (f"<article><p><b><i><u><s><em><strong><span></span></strong></em></s></u></i></b><div>{BODY}</div></article>", True),
    (f"<div class='content has-sidebar'><div id=page-header><main>{BODY}</main></div></div>", True),
    (f"<article class='post widget'>{BODY}</article>", True),
    (f"<div class=sidebar><p>Aside</div><article>{BODY}</article>", True),
    (f"<article>{BODY}</article><div id=comments><article class=comment-body><p>Nice one</article></div>", True),
    (f"<div class='share' role='navigation'><article>{BODY}</article></div>", False),
])
def test_articles_are_not_dropped_by_words_in_attributes(page, want):
    assert html_extract.extract_text(page, PRIOR).endswith("The text of the article is here.") == want
    if want and "class='content" not in page:
        assert html_extract.extract_text(page, PRIOR) == "The text of the article is here."


def test_nested_named_elements_are_read_once():
    page = "<div class=ad>" * 5000 + f"<article>{BODY}</article>"
    assert html_extract.extract_text(page, PRIOR) == "The text of the article is here."


def test_extract_query(spark):
    rows = [(1, "u", "<html><body><div><a>x</a></div><article><p>Long text of the page.</p></article>"),
            (2, None, None), (3, "v", ""), (3, "v", ""), (4, "w", "<p>" + "word " * 50_000)]
    df = frame(spark, rows).withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit("clash"))
    got = {r["page_id"]: r for r in html_extract.extract(df).collect()}
    assert got[1]["text"] == "Long text of the page." and got[1]["n_chars"] == 22
    assert got[2]["text"] == "" and got[2]["url"] is None and got[4]["n_chars"] == 249_999
    assert html_extract.extract(df).count() == 5 and html_extract.extract(df.limit(0)).count() == 0


def test_weights_come_from_labelled_pages():
    page = "<div><a>one</a><a>two</a></div>" * 40 + "<article>" + "<p>ten words of the text in here are so good</p>" * 40 + "</article>"
    w = html_extract.weights_from(dict(html_extract.count_tokens(page)))
    assert w["text"] > 0 > w["p"] > w["a"] and w["div"] < w["p"]
    assert not html_extract.count_tokens("<p>no label here</p>")


# ---------------------------------------------------------------------- components

def test_components_equal_union_find(spark):
    rnd = random.Random(7)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(200)]
    edges += [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(50)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {x: find(x) for x in parent}


# ------------------------------------------------------------------------ pipeline

def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    bench = [r["text"] for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    before = {r["doc_id"]: r for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "jaccard_join", "decontaminate", "pii", "bpe"]
    state = docs
    kept = []
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, state, SF_SMALL)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        path = os.path.join(tempfile.mkdtemp(), "stage")
        out.write.parquet(path)
        state = spark.read.parquet(path)
        kept.append({r["doc_id"]: r["text"] for r in state.collect()})
    assert len(before) >= len(kept[0]) > len(kept[1]) > 0.5 * len(before)
    assert len(set(kept[1].values())) == len(kept[1])
    assert not any(b in t for t in kept[2].values() for b in bench)
    assert any(b in t for t in kept[1].values() for b in bench)
    assert set(kept[3]) == set(kept[2]) and not any("@mail" in t for t in kept[3].values())
    last = corpus_pipeline.tokens(spark, state, SF_SMALL).collect()
    for r in last:
        assert r["decoded_sha256"] == hashlib.sha256(kept[3][r["doc_id"]].encode()).hexdigest()
        assert len(r["ids"]) == 4 * r["n_tokens"]


def test_near_duplicates_equal_brute_force_of_five_words(spark):
    rnd = random.Random(21)
    own = lambda d, n: [f"w{d}x{k}" for k in range(n)]
    rows = []
    for d in range(0, 60, 2):                             # a document and a copy with one block more
        w = own(d, 100)
        at = rnd.choice([0, 50, 100])
        rows += [(d, " ".join(w)), (d + 1, " ".join(w[:at] + own(d + 1, rnd.randint(8, 30)) + w[at:]))]
    for d in range(100, 140, 2):                          # scattered edits
        w = own(d, 200)
        v = [x + "e" if k in {20, 60, 100, 140}.union({170} if d % 4 else set()) else x
             for k, x in enumerate(w)]
        rows += [(d, " ".join(w)), (d + 1, " ".join(v))]

    def grams(t):
        w = t.split()
        return {tuple(w[k:k + 5]) for k in range(len(w) - 4)}

    gone, between = set(), 0
    for (_, s), (d, t) in zip(rows[::2], rows[1::2], strict=True):
        a, b = grams(s), grams(t)
        like = len(a & b) / len(a | b)
        between += 0.8 <= like < 0.85
        if like >= 0.8:
            gone.add(d)
    assert between >= 10 and len(gone) < len(rows) / 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF_SMALL).collect()}
    assert left == {d for d, _ in rows} - gone


def test_stages_take_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "same words here"), (3, "same words here"), (None, "no id text"),
            (4, "other words there"), (5, "x " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cid", F.lit(1)) \
        .withColumn("n_chars", F.length("text").cast("long"))
    out = corpus_pipeline.near_duplicates(spark, docs, SF_SMALL)
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "2", "3", "4", "5", "None"]
    for _, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs, SF_SMALL).columns == docs.columns
        assert step(spark, docs.limit(0), SF_SMALL).count() == 0
