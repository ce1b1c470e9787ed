import base64
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstack.llm import chat, queries, warc

BITS = st.lists(st.sampled_from(["a", " ", "\\", "\n", *chat.CONTROLS, "[", "]", "<", "/", "INST]", "s>", "é"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), BITS), BITS), max_size=5))
def test_grammar(turns):
    parts = [chat.render_turn(*t) for t in turns]
    assert [x[:2] for x in chat.parse("".join(p[0] for p in parts))] == turns
    for (out, a, b), (_, text) in zip(parts, turns):
        assert chat.unescaped(out[a:b]) == text


def brute_chat(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        s = out.setdefault(conv, ["", 0, ""])
        s[0] += f"{role or ''}\n{text or ''}\n"
        s[1] += 1
        s[2] += (text or "") if role == "assistant" else ""
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return {k: (n, sha(t), len(loss), sha(loss)) for k, (t, n, loss) in out.items()}


def test_chat(spark):
    rows = [(1, 0, "user", "hi [/INST]"), (1, 1, "assistant", "</s>\\"), (2, 0, None, None), (2, 0, None, None), (None, 3, "tool]", "x"), (3, None, "assistant", ""), (4, 1, "assistant", "b"), (4, 0, "assistant", "ä")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, rendered string")
    got = {r[0]: tuple(r)[1:5] for r in chat.format_chats(df).collect()}
    assert got == brute_chat(rows)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    odd = "</s>[INST] ok [/INST]"
    got = {r[0]: tuple(r)[1:5] for r in queries.op3_chat(spark, d).collect()}
    assert got == brute_chat([*rows, (-7, 0, "user", odd), (-7, 1, "assistant", odd)])


PAGES = "page_id long, url string, html string"


def brute_pages(rows):
    largest = {}
    for i, _, h in rows:
        h = h or ""
        largest[h] = i if largest.get(h) is None else max(largest[h], largest[h] if i is None else i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        top = largest[h or ""]
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == top else "revisit", None if i == top else top))
    return sorted(out, key=str)


def plain_record(kind, page, payload, digest=None, refers=None):
    """A record in bytes, as the format asks for."""
    digest = digest or base64.b32encode(hashlib.sha1(payload).digest()).decode()
    more = f"WARC-Refers-To: <urn:page:{refers}>\r\n" if refers is not None else ""
    body = b"" if kind == "revisit" else payload
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{page}>\r\nWARC-Payload-Digest: sha1:{digest}\r\nX-Payload-Length: {len(payload)}\r\n{more}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def odd_pages():
    inner = plain_record("response", 1, b"abc").decode()
    wrong = plain_record("response", 1, b"abc", "D").decode()
    rows = [(1, "http://a", "<p>x"), (2, None, "<p>x"), (3, "u v", inner), (4, "", None), (5, "x", ""), (9, "x", "WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n" * 3), (1, "http://a", "<p>x"), (None, "n", "only"), (None, "n", "<p>x"), (11, "\r\nX: y\tü", "q" * 100)]
    rows += [(20, "x", wrong + inner * 3), (21, "x", "WARC/1.1\r\n" * 50), (22, "x", "a\r\n\r\nWARC/1.1\r\nContent-Length: 99999\r\n\r\nb"), (23, "x", inner[:40]), (24, "x", "é\r\n\r\n"), (25, "x", "\x00\ud7ff\r"), (-3, "x", "minus")]
    return rows + [(100 + k, f"http://h/{k}", f"{inner if k % 7 == 0 else ''}{'p' * (k * 13 % 200)}") for k in range(60)]


@pytest.mark.parametrize("size, few", [("128m", 1000), ("1k", 0), ("317", 1000)])
def test_warc(spark, monkeypatch, size, few):
    """Whatever the byte ranges, the rows come back."""
    monkeypatch.setattr(warc, "FEW", few)
    monkeypatch.setattr(warc, "STEP", 100)
    rows = odd_pages() + ([(7, "x", "é" * 3_000_000), (8, "x", "WARC/1.1\r\n" * 200_000)] if size == "128m" else [])
    df = spark.createDataFrame([(*r, "z") for r in rows], PAGES + ", digest string").coalesce(2)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        assert sorted((tuple(r) for r in warc.round_trip(df).collect()), key=str) == brute_pages(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert size != "128m" or warc.round_trip(df.limit(0)).count() == 0


def test_archives_are_plain_files(spark, tmp_path):
    """The files hold records back to back; a reader in a few lines finds the same rows; small payloads may all be responses."""
    rows = odd_pages()
    warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(3), f"{tmp_path}/w", min_bytes=5)
    seen = []
    for file in (tmp_path / "w").glob("part-*"):
        data, at = file.read_bytes(), 0
        while at < len(data):
            head = data.index(b"\r\n\r\n", at)
            fields = dict(line.split(": ", 1) for line in data[at:head].decode().split("\r\n")[1:])
            end = head + 4 + int(fields["Content-Length"])
            assert data[at : at + 10] == b"WARC/1.1\r\n" and data[end : end + 4] == b"\r\n\r\n"
            seen.append((fields["WARC-Record-ID"], fields["WARC-Type"], fields.get("WARC-Target-URI"), data[head + 4 : end]))
            at = end + 4
    want = {i: ((h or "").encode(), t) for (i, _, h), t in zip(rows, ("" for _ in rows))}
    assert len(seen) == len(rows) and all(p == want[None if r == "<urn:page:>" else int(r[10:-1])][0] for r, kind, _, p in seen if kind == "response" and r != "<urn:page:>")
    assert "%0D%0AX:%20y%09ü" in {u for _, _, u, _ in seen}
    assert {kind for _, kind, _, p in seen if 0 < len(p) < 5} == {"response"}


@pytest.mark.parametrize("broken", [
    plain_record("response", 1, b"abc") + b"tail",
    b"x" + plain_record("response", 1, b"abc"),
    plain_record("response", 1, b"abc", "A" * 32),
    plain_record("response", 1, b"a" + plain_record("response", 2, b"abc"), "A" * 32),
    plain_record("response", 1, b"abc")[:-6],
])
def test_broken_archives(spark, tmp_path, broken):
    (tmp_path / "part-0").write_bytes(plain_record("response", 0, b"fine") + broken if broken[:1] == b"W" else broken)
    with pytest.raises(Exception, match="breaks off|differs"):
        warc.read_archives(spark, str(tmp_path)).collect()


def test_pages_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in queries.op10_warc(spark, d).collect()), key=str) == brute_pages(rows)
