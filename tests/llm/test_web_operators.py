"""URL reputation, chat formatting, HTML extraction, WARC, packing."""

import base64
import hashlib
import io
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat_format, html_extract, packing, queries, url_filters, warc

# URL filters


def judged(spark, urls, outcomes=(), **more):
    pages = spark.createDataFrame([(k, u, "clash", "clash") for k, u in enumerate(urls)], "page_id long, url string, host string, good string")
    return {r.page_id: r for r in url_filters.filter_urls(pages, spark.createDataFrame(list(outcomes), "page_id long, good boolean"), **more).collect()}


def test_rules_host_and_path(spark):
    urls = ["http://A.Example.ORG/en/12?x", "https://x.org/", "https://x.org", "http://example.org/es/1#a", "http://notexample.org/es/1", "http://b.com/fr/1", "http://b.com/de/1", "http://b.com/de", None, "", "no scheme", "a://b://c/d", "http://com/fr/x"]
    got = judged(spark, urls)
    assert [got[k].rule for k in range(13)] == ["example.org/en/1", "org/", None, "example.org/es/", "org/", "com/fr/", "com/de/", None, None, None, None, None, "com/fr/"]
    assert got[0].host == "a.example.org" and got[0].path == "/en/12" and got[0].verdict == "block"
    assert (got[8].host, got[8].path, got[8].verdict) == ("", "", "allow") and got[11].host == "b:"
    assert judged(spark, []) == {}


def test_reputation_shrinks_to_parents(spark):
    urls = [f"http://bad.site.net/{k}" for k in range(60)] + [f"http://fine{k % 9}.good.net/{k}" for k in range(90)] + ["http://new.site.net/x", "http://new.good.net/x"]
    rows = [(k, k >= 60) for k in range(150)] + [(0, False), (9999, True), (70, None)]
    got = judged(spark, urls, rows)
    assert got[0].verdict == "block" and got[60].verdict == "allow"
    assert got[150].rate < got[151].rate and got[151].verdict == "allow"
    assert abs(judged(spark, ["http://a.b/"])[0].rate - 0.5) < 1e-9


def test_hosts_pool_by_clean_keys_and_suffixes(spark):
    hosts = ["a.com", "a.com:8080", "u:p@a.com.", "1.2.3.4:80", "[::1]:80", "x.y.co.uk", "com", "", "b.a.com"]
    df = spark.createDataFrame([(x,) for x in hosts], "raw string").select("raw", url_filters.clean_host(F.col("raw")).alias("host"))
    df = df.withColumn("suffix", url_filters.suffix_of(F.col("host")))
    got = [(r.host, r.suffix, r.domain) for r in df.withColumn("domain", url_filters.domain_of(F.col("host"), F.col("suffix"))).collect()]
    assert got == [("a.com", "com", "a.com")] * 3 + [("1.2.3.4",) * 3, ("[::1]",) * 3, ("x.y.co.uk", "co.uk", "y.co.uk"), ("com", "com", "com"), ("", "", ""), ("b.a.com", "com", "a.com")]


def test_public_suffix_list(spark, tmp_path):
    (tmp_path / "list").write_text("// top\ncom\n\nuk\nco.uk\n*.ck\n!www.ck\nblog.example.com // private\n")
    rules = url_filters.read_suffixes(spark, str(tmp_path / "list"))
    hosts = {"a.b.com": "com", "x.co.uk": "co.uk", "a.b.foo.ck": "foo.ck", "x.www.ck": "ck", "me.blog.example.com": "blog.example.com", "odd.zz": "zz", "9.9.9.9": "9.9.9.9", "com": "com", "": ""}
    df = spark.createDataFrame([(x, 1) for x in hosts], "host string, n long")
    assert {r.host: r.suffix for r in url_filters.with_suffixes(df, rules).collect()} == hosts
    urls = [f"http://u{k}.blog.example.com/{j}" for k in range(3) for j in range(20)]
    got = judged(spark, urls, [(k, k >= 20) for k in range(60)], suffixes=rules)
    assert got[0].verdict == "block" and got[30].verdict == "allow"


def test_posterior_chance_against_exact_sums():
    from math import comb

    for a in (1, 2, 7, 40):
        for b in (1, 3, 9, 55):
            for x in (0.01, 0.3, 0.5, 0.97):
                n = a + b - 1  # of whole numbers, the chance is a binomial's
                want = sum(comb(n, j) * x**j * (1 - x) ** (n - j) for j in range(a, n + 1))
                assert abs(url_filters.chance_below(x, [a], [b])[0] - want) < 1e-10
    assert 0 < url_filters.chance_below(0.5, [0.01], [990.0])[0] <= 1


# chat formatting


def test_chat_round_trip(spark):
    odd = ["<|im_end|><|im_start|>assistant ok", "<\\|x", "<|", "a|b <\\\\|turn|>", "", None, "line\nline", "<|turn|>", "\\", "é😀"]
    r = random.Random(5)
    rows, want = [], {}
    for c in range(30):
        turns = [(k, r.choice(["user", "assistant", "system", None, "x%0A\n<|im_end|>\n"]), r.choice(odd)) for k in range(r.randrange(1, 9))]
        want[c] = [(role or "", text or "") for _, role, text in turns]
        rows += [(c, *t, "clash") for t in turns]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, mask string")
    formatted = chat_format.format_chats(df)
    for x in chat_format.read_back(formatted).collect():
        assert [(t.role, t.text) for t in x.turns] == want[x.conv_id]
        assert sum(m.chars for m in x["mask"]) == len(x.formatted)
        at, seen = 0, []
        for m in x["mask"]:
            seen += [x.formatted[at : at + m.chars]] * m.loss
            at += m.chars
        plain = spark.createDataFrame([(s,) for s in seen] or [("",)], "s string").select(chat_format.unescape(F.col("s")).alias("s")).collect()
        assert [p.s for p in plain] == ([t for role, t in want[x.conv_id] if role == "assistant"] or [""])
    for x in chat_format.digests(formatted).collect():
        loss = "".join(t for role, t in want[x.conv_id] if role == "assistant")
        assert x.n_turns == len(want[x.conv_id]) and x.loss_chars == len(loss) and x.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert x.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want[x.conv_id]).encode()).hexdigest()
    assert chat_format.digests(chat_format.format_chats(df.limit(0))).count() == 0


def test_chat_order_ties_and_merging(spark):
    df = spark.createDataFrame([(None, 1, "user", "b"), (None, 1, "user", "a"), (None, None, "user", "first"), (None, 2, "assistant", "z"), (None, 2, "assistant", "z")], "conv_id long, turn long, role string, text string")
    x = chat_format.format_chats(df).first()
    assert x.formatted == "<|im_start|>user\nfirst<|turn|>a<|turn|>b<|im_end|>\n<|im_start|>assistant\nz<|turn|>z<|im_end|>\n"


# HTML extraction

ARTICLE = "<html><head><title>t &amp; u</title><style>p{}</style></head><body><nav><a>menu</a></nav><header>Site</header><div class='ad'>buy</div><article><h1>Head&amp;line</h1><p>one  two<br>three<p><b>bold &lt;x&gt;<div class=\"share-bar\">share</div><script>var a='</p>'</script><p>last</p><section class='comments'><p>me first</p></section></article><footer>&copy; us</footer></body></html>"


def extracted(spark, rows, **more):
    df = spark.createDataFrame([(k, u, h, "clash") for k, (u, h) in enumerate(rows)], "page_id long, url string, html string, text string")
    return {r.page_id: r.text for r in html_extract.extract(df, **more).collect()}


def test_article_text(spark):
    got = extracted(spark, [("http://a/", ARTICLE), ("http://a/", None), (None, ""), ("x", "plain &amp text"), ("x", "<p>a<p>b</div><!-- c --><p>d <i>e</i>f"), ("x", "<div><header>top</header><p>body</p></div>"), ("x", "<p a='>'>q</p><p b=\"unclosed>r</p>"), ("x", "<article><p>teaser</p></article><article><p>the long article</p></article>")])
    assert got[0] == "Head&line\none two three\nbold <x>\nlast"
    assert got[1] == got[2] == "" and got[3] == "plain & text" and got[4] == "a\nb\nd ef" and got[5] == "body" and got[6].startswith("q\n") and got[7] == "the long article"
    assert extracted(spark, []) == {}


@pytest.mark.parametrize("limit", [1000, 0])
def test_template_subtrees_go_where_they_recur(spark, limit):
    page = lambda k: f"<body><div id=x><p>Our slogan of this site</p></div><p>story {k}</p><p>shared {k % 2}</p></body>"
    rows = [("http://one.net/%d" % k, page(k)) for k in range(12)] + [("http://two.net/1", page(1)), ("http://copy.net/1", page(3))] + [("http://copy.net/2", page(3))] * 9
    got = extracted(spark, rows, broadcast_rows=limit, min_share=0.6)
    assert all(got[k] == f"story {k}\nshared {k % 2}" for k in range(12))
    assert got[12] == "Our slogan of this site\nstory 1\nshared 1"
    assert got[13] == got[22] == "Our slogan of this site\nstory 3\nshared 1"  # copies of one page are no template


def test_recurring_article_text_stays(spark):
    rows = [("http://one.net/", f"<article><p>Licence line</p><p>{k}</p></article><div>side</div>") for k in range(20)]
    assert set(extracted(spark, rows).values()) == {f"Licence line\n{k}" for k in range(20)}


@pytest.mark.parametrize("limit", [1000, 0])
def test_recurring_boxes_inside_articles_go(spark, limit):
    box = "<div class='x7'><p>Read this too</p><ul><li><a href=/1>One</a></li></ul></div>"
    prose = "<div><p>Reprinted a</p><p>Reprinted b</p></div>"
    page = lambda k: f"<article><p>story {k}</p>{box if k % 2 else ''}<div>Licence line</div><div>Under <a rel='license' href=/cc>CC</a></div>{prose if k < 4 else ''}</article>"
    got = extracted(spark, [("http://one.net/", page(k)) for k in range(20)] + [("http://two.net/", page(1))], broadcast_rows=limit)
    licence, again = "\nLicence line\nUnder CC", "\nReprinted a\nReprinted b"
    assert all(got[k] == f"story {k}{licence}{again if k < 4 else ''}" for k in range(20))
    assert got[20] == f"story 1\nRead this too\nOne{licence}{again}"


@pytest.mark.parametrize("limit", [1000, 0])
def test_every_article_of_a_page(spark, tmp_path, limit):
    story = lambda k: f"<article><h1>one {k}</h1></article><div><article><p>two, the longer {k}</p><math><mi>x</mi></math></article></div>"
    other = "<div class='teasers'><article>tease</article></div><article class='comment'><p>me first</p></article><aside><article>side</article></aside><article><p>recurring teaser of the site, longer than the rest of it</p></article>"
    rows = [("http://one.net/", story(k) + other) for k in range(8)] + [("http://two.net/", "<article class='comment'>all there is</article>"), ("http://two.net/", "<main>a</main><p>x</p><main>b</main>")]
    got = extracted(spark, rows, broadcast_rows=limit, every=True)
    assert all(got[k].startswith(f"one {k}\ntwo, the longer {k}") and got[k].endswith("x\nrecurring teaser of the site, longer than the rest of it") for k in range(8))  # the longest is never template
    assert got[8] == "all there is" and got[9] == "a\nb"
    short = other.replace(", longer than the rest of it", "")
    got = extracted(spark, [("http://one.net/", story(f"{k} " + "more " * 20) + short) for k in range(8)], broadcast_rows=limit, every=True)
    assert all("one" in got[k] and "two" in got[k] and got[k].endswith("x") for k in range(8))
    spark.createDataFrame([(1, "u", story(1))], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert queries.op6_html_extract(spark, str(tmp_path)).first().text.startswith("one 1\ntwo")


def test_words_of_classes_name_parts_not_subjects(spark):
    kept = "<div class='social-policy'>policy</div><div id='notice-board-history'>board</div><p class='ad-hoc'>hoc</p><map><p>area</p></map>"
    gone = "<div class='cookie-notice x'>c</div><div id='ad-slot-3'>a</div><ul class='related-articles'><li>r</li></ul><div class='share_bar'>s</div><div class='comments-list'>me</div>"
    got = extracted(spark, [("u", f"<article><p>one</p>{kept}{gone}</article>"), ("u", "<article><p>tie a</p></article><article><p>tie b</p></article>")])
    assert got[0] == "one\npolicy\nboard\nhoc\narea" and got[1] == "tie a"


def made_page(r, host, k):
    """A page of a host and its text: the host's boxes stand outside and inside the article, under names that say nothing."""
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8)))
    body = [" ".join(word() for _ in range(r.randrange(1, 30))) for _ in range(r.randrange(1, 7))]
    box = f"<div class=k{host}><p>More from {host} &amp; co</p><ul><li><a href=/>Front</a></ul></div>"
    at = r.randrange(len(body) + 1)
    inner = "".join(f"<p>{x.replace(' ', r.choice([' ', '  ', chr(10)]))}</p>" for x in body[:at]) + box + "".join(f"<div>{x}</div>" for x in body[at:])
    outer = f"<div><p>Welcome to {host}</p><p>Since 1900</p></div>"
    page = f"<body>{outer}<section><article><h1>t{k}</h1>{inner}</article></section>{box}</body>" if k % 3 else f"<body>{outer}<h1>t{k}</h1>{inner}{box}</body>"
    return page, "\n".join([f"t{k}", *body])


@pytest.mark.parametrize("limit", [1000, 0])
def test_site_templates_against_known_texts(spark, limit):
    r = random.Random(12)
    made = [(f"http://h{k % 4}.net/{k}", *made_page(r, f"h{k % 4}", k)) for k in range(120)]
    got = extracted(spark, [(u, h) for u, h, _ in made], broadcast_rows=limit, every=True)
    assert got == {k: text for k, (_, _, text) in enumerate(made)}
    none = extracted(spark, [(u, h) for u, h, _ in made], min_pages=10**6, every=True)
    assert all("More from" in x for x in none.values())  # it is the template set that takes the boxes away


def test_very_long_and_deep_page(spark):
    got = extracted(spark, [("u", "<div>" * 3000 + "deep" + "<p>x y</p>" * 5000)])
    assert got[0] == "\n".join(["deep"] + ["x y"] * 5000)


# WARC


def archive(spark, rows, **more):
    df = spark.createDataFrame([(i, u, h, "clash") for i, u, h in rows], "page_id long, url string, html string, record_type string")
    written = warc.write_archives(df, **more)
    return written, warc.read_archives(written).collect()


def test_warc_round_trip(spark):
    r = random.Random(6)
    html = [None, "", "same", "same\r\n\r\nWARC/1.1", "é😀" * 500] + ["".join(r.choice("abc <>\r\n") for _ in range(r.randrange(3000))) for _ in range(40)]
    rows = [(k, f"http://x/{k}\r\n" if k % 5 else None, html[k % len(html)]) for k in range(100)] + [(None, "n", "same"), (2, "again", "same")]
    written, out = archive(spark, rows, archive_bytes=5000)
    assert len(out) == len(rows) and written.count() > 1
    by = {}
    for i, _, h in rows:
        by.setdefault((h or "").encode(), []).append(i)
    first = {p: min(i for i in ids if i is not None) for p, ids in by.items()}
    for x in out:
        p = next(p for p in by if x.payload_digest == base64.b32encode(hashlib.sha1(p).digest()).decode() and x.page_id in by[p])
        assert x.payload_bytes == len(p)
        assert (x.record_type, x.refers_to) == (("response", None) if x.page_id == first[p] else ("revisit", first[p]))
        assert x.payload is None if x.record_type == "revisit" else bytes(x.payload) == p
    small = archive(spark, rows, min_bytes=5)[1]
    assert sum(x.record_type == "revisit" for x in small) == sum(len(ids) - sum(i == first[p] for i in ids) for p, ids in by.items() if len(p) >= 5)
    assert archive(spark, [])[1] == []


def test_warc_reader_refuses_damage(spark, tmp_path):
    record = warc.record(1, "http://x/", b"payload", warc.digest(b"payload"))
    import zstandard

    frame = zstandard.ZstdCompressor().compress(record)
    good = warc.head(b"") + frame
    assert [warc.parse_record(x)["payload"] for _, x in warc.frames(io.BytesIO(good), piece=3)] == [b"payload"]
    for bad in (frame, good[:-3], good + b"junk", b"", warc.head(b"")[:5]):
        with pytest.raises(warc.BadArchive):
            list(warc.frames(io.BytesIO(bad)))
    for old, new in ((b"payload\r\n", b"paxload\r\n"), (b"WARC/1.1", b"WARC/9.9"), (b"Content-Length: ", b"Content-Length: 9"), (b"WARC-Date", b"WARC-Dote")):
        with pytest.raises(warc.BadArchive):
            warc.parse_record(record.replace(old, new))
    with pytest.raises(Exception, match="records"):
        written, _ = archive(spark, [(1, "u", "x")])
        warc.read_archives(written.withColumn("records", F.lit(9).cast("long"))).collect()


def test_warc_of_others(spark, tmp_path):
    """A dictionary without a content size, other record types, no payload digest, chunked bodies, folded headers."""
    import struct

    import zstandard

    rec = lambda kind, block, more=b"", version=b"WARC/1.0": version + b"\r\nWARC-Type: " + kind + b"\r\nWARC-Record-ID: <urn:x>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\n" + more + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    dictionary = zstandard.train_dictionary(2000, [b"HTTP/1.1 200 OK some words of a page %d" % k * 20 for k in range(200)]).as_bytes()
    one = zstandard.ZstdCompressor(write_content_size=False).compressobj()
    packed = one.compress(dictionary) + one.flush()
    records = [
        rec(b"warcinfo", b"software: x\r\n"),
        rec(b"request", b"GET / HTTP/1.1\r\n\r\n", b"Content-Type: application/http; msgtype=request\r\n"),
        rec(b"response", b"HTTP/1.1 200 OK\r\n\r\n" + b"page" * 50_000, b"WARC-Target-URI: <http://a/>\r\nX-Long: a\r\n b\r\n"),
        rec(b"response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Length: 99\r\n\r\n3\r\nabc\r\n0\r\n\r\n", b"WARC-Payload-Digest: sha1:AAAA\r\n"),
        rec(b"revisit", b"", b"WARC-Payload-Digest: sha1:ABCD\r\n"),
        rec(b"metadata", b"x: y"),
    ]
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    (tmp_path / "a.warc.zst").write_bytes(struct.pack("<II", warc.SKIPPABLE, len(packed)) + packed + b"".join(map(packer.compress, records)))
    out = warc.read_archives(spark.createDataFrame([(str(tmp_path / "a.warc.zst"), None)], "path string, records long")).collect()
    assert [(x.record_type, x.url, x.payload_bytes, x.payload_digest) for x in out] == [("response", "http://a/", 200_000, warc.digest(b"page" * 50_000)), ("response", None, 13, "AAAA"), ("revisit", None, None, "ABCD")]
    again = warc.record(2, "http://b/", b"x", warc.digest(b"x"), (1, "http://a/"))
    first = warc.record(1, "http://a/", b"x", warc.digest(b"x"))
    number = lambda name, raw: next(x.partition(b": ")[2] for x in raw.split(b"\r\n") if x.startswith(name + b":"))
    assert number(b"WARC-Refers-To", again) == number(b"WARC-Record-ID", first) and number(b"WARC-Refers-To-Target-URI", again) == b"http://a/"


def test_warc_record_longer_than_an_archive(spark):
    rows = [(k, "u", f"{k} " * n) for k, n in enumerate([5, 200_000, 5, 90_000])]
    written, out = archive(spark, rows, archive_bytes=100)
    assert {x.page_id: bytes(x.payload).decode() for x in out} == {k: h for k, _, h in rows} and written.count() == 4


# packing


def test_best_bounds_is_optimal():
    r = random.Random(7)
    for _ in range(40):
        h = {x: r.randrange(1, 30) for x in r.sample(range(1, 40), r.randrange(1, 9))}
        k = r.randrange(1, 5)
        got = packing.best_bounds(h, k)
        assert len(got) <= k and got[-1] == max(h) and got == sorted(got)
        best = min(packing.padding(h, sorted({*c, max(h)})) for n in range(min(k, len(h))) for c in itertools.combinations(sorted(h), n))
        assert packing.padding(h, got) == best
    assert packing.best_bounds({}, 3) == []


words = lambda text: len(text.split())  # noqa: E731  pickled by value


def test_pack_places_every_token_once(spark):
    r = random.Random(8)
    texts = [None, "", "a " * 700] + ["w " * r.randrange(0, 90) for _ in range(400)]
    df = spark.createDataFrame([(k if k % 7 else 7, t, "clash") for k, t in enumerate(texts)] + [(None, "x y", "")], "doc_id long, text string, batch string")
    out = packing.pack(df, words, context=64, buckets=4, budget=256).collect()
    assert sum(x.length for x in out) == sum(1 + words(t or "") for t in texts) + 3
    assert all(1 <= x.length <= x.bound <= 64 and x.start == 64 * x.part for x in out) and len({x.bound for x in out}) <= 4
    batches = {}
    for x in out:
        batches.setdefault((x.bucket, x.batch), []).append(x)
    for rows in batches.values():
        assert sorted(x.slot for x in rows) == list(range(len(rows))) and {x.batch_rows for x in rows} == {len(rows)} and len(rows) * rows[0].bound <= 256
    short = [k for k, rows in batches.items() if len(rows) < 256 // rows[0].bound]
    assert len({b for b, _ in short}) == len(short)  # only a bucket's last batch
    assert packing.pack(df.limit(0), words).count() == 0
