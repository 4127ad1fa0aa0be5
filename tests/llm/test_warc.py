import gzip
import random
import zlib

from sparkloom.llm import warc

HTML = b"<html><head><title>T</title><script>x</script></head><body><nav>menu</nav><p>caf\xc3\xa9 &amp; more</p></body></html>"


def response(body, status=b"200 OK", kind=b"text/html; charset=utf-8", stated=None, rid="<urn:uuid:1>"):
    block = b"HTTP/1.1 " + status + b"\r\nContent-Type: " + kind + b"\r\nX-A: 1\r\nX-A: 2\r\n\r\n" + body
    return warc.serialise([("WARC-Type", "response"), ("WARC-Record-ID", rid), ("WARC-Target-URI", "http://e.org/"), ("WARC-Date", "2020-01-01T00:00:00Z"), ("WARC-IP-Address", "1.2.3.4"), ("WARC-Payload-Digest", stated or warc.digest(body)), ("Content-Length", str(len(block)))], block)


def test_round_trip():
    a, b = response(HTML), response(b"plain", kind=b"text/plain", rid="<urn:uuid:2>")
    for data in (a + b, gzip.compress(a) + gzip.compress(b), a + b"junk" + b):
        got = list(warc.records(data))
        assert [warc._get(f, "WARC-Record-ID") for f, _ in got] == ["<urn:uuid:1>", "<urn:uuid:2>"]
        assert b"".join(warc.serialise(f, x) for f, x in got) == a + b


def test_derivatives_link_to_their_response(spark):
    data = response(HTML) + warc.serialise([("WARC-Type", "request"), ("Content-Length", "2")], b"GE") + response(b"\x89PNG", kind=b"image/png", rid="<urn:uuid:3>") + response(b"t x", kind=b"text/plain", stated="sha1:WRONG", rid="<urn:uuid:4>")
    df = spark.createDataFrame([(1, gzip.compress(data)), (2, b""), (3, None), (4, b"WARC/1.0\r\nContent-Length: 99\r\n\r\nx")], "k bigint, content binary")
    got = {(r.refers_to, r.kind): r for r in warc.with_members(warc.derivatives(df, key="k")).collect()}
    assert set(got) == {("<urn:uuid:1>", "metadata"), ("<urn:uuid:1>", "conversion"), ("<urn:uuid:3>", "metadata"), ("<urn:uuid:4>", "metadata"), ("<urn:uuid:4>", "conversion")}
    x = got["<urn:uuid:1>", "conversion"]
    assert bytes(x.block).decode() == "menu café & more" and x.digest_ok and x.status == 200 and x.source_headers["X-A"] == "1, 2"
    assert x.headers["WARC-Payload-Digest"] == warc.digest(HTML) and x.block_digest == warc.digest(bytes(x.block)) and x.headers["WARC-IP-Address"] == "1.2.3.4"
    assert not got["<urn:uuid:4>", "conversion"].digest_ok
    again = list(warc.records(b"".join(bytes(r.member) for r in got.values())))
    assert len(again) == 5 and {(warc._get(f, "WARC-Refers-To"), warc._get(f, "WARC-Type")) for f, _ in again} == set(got)
    assert b"digest-holds: no" in bytes(got["<urn:uuid:4>", "metadata"].block)


def test_pages_become_archives(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>x</p>"), (2, None, None), (2, None, None)], "page_id bigint, url string, html string")
    got = warc.derivatives(warc.responses(pages), key="page_id").where("kind = 'conversion'").collect()
    assert sorted((r.page_id, bytes(r.block)) for r in got) == [(1, b"x"), (2, b""), (2, b"")] and all(r.digest_ok for r in got)
    assert warc.derivatives(warc.responses(pages.limit(0)), key="page_id").count() == 0


def chunked(r, body):
    out = b""
    while body:
        n = r.randint(1, 40)
        out += b"%x;ext=1\r\n" % len(body[:n]) + body[:n] + b"\r\n"
        body = body[n:]
    return out + b"0\r\n\r\n"


def test_random_archives_against_what_they_were_made_of(spark, tmp_path):
    """Texts, links and digests against the pages that went in, for all encodings, in one archive per file and streamed in small steps."""
    r, want = random.Random(17), {}
    for f in range(4):
        parts = []
        for i in range(25):
            rid, words = f"<urn:uuid:{f}-{i}>", [f"wörd{r.randint(0, 999)}" for _ in range(r.randint(0, 60))]
            charset = r.choice(["utf-8", "latin-1", "utf-16"])
            page = "<html><body>" + "".join(f"<p>{w}</p>" for w in words) + "</body></html>"
            body, head = page.encode(charset), f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset={charset}\r\n"
            coding = r.choice(["", "gzip", "deflate", "raw deflate", "br"])
            if coding:
                body = {"gzip": lambda b: gzip.compress(b), "deflate": lambda b: zlib.compress(b), "raw deflate": lambda b: zlib.compress(b)[2:-4], "br": lambda b: b"?" + b}[coding](body)
                head += f"Content-Encoding: {coding.split()[-1]}\r\n"
            whole, sent = body, body
            if r.random() < 0.5:
                sent, head = chunked(r, body), head + "Transfer-Encoding: chunked\r\n"
            stated = r.choice([warc.digest(whole), warc.digest(sent), "sha1:" + "A" * 32])
            block = head.encode() + b"\r\n" + sent
            parts.append(warc.serialise([("WARC-Type", "response"), ("WARC-Record-ID", rid), ("WARC-Payload-Digest", stated), ("Content-Length", str(len(block)))], block))
            want[rid] = (None if coding == "br" else " ".join(words), not stated.endswith("A" * 32), warc.digest(whole))
            if r.random() < 0.2:
                parts.append(b"damage WARC/1.0\r\nContent-Length: 99999999\r\n\r\n")
        data = b"".join(map(gzip.compress, parts)) if f % 2 else b"".join(parts)
        (tmp_path / f"{f} a.warc").write_bytes(data)
    for got in (warc.archive_derivatives(spark, str(tmp_path), 1000).collect(), warc.derivatives(spark.read.format("binaryFile").load(str(tmp_path))).collect()):
        assert len(got) == sum(2 - (t is None) for t, _, _ in want.values())
        for x in got:
            text, fine, own = want[x.refers_to]
            assert x.digest_ok == fine and (fine or x.headers["WARC-Payload-Digest"] == own)
            if x.kind == "conversion":
                assert bytes(x.block).decode() == text
    head = next(iter(warc.records(gzip.compress(parts[0])[:-9] + gzip.compress(parts[1]))), None)
    assert head is not None


def test_a_damaged_member_is_passed_over():
    a, b = response(HTML), response(HTML, rid="<urn:uuid:2>")
    bad = bytearray(gzip.compress(a))
    bad[20:40] = bytes(20)
    assert [warc._get(f, "WARC-Record-ID") for f, _ in warc.records(bytes(bad) + gzip.compress(b))][-1] == "<urn:uuid:2>"
