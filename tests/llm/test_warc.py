"""WARC files as they are published: versions, gzip members, charsets, blocks that hold a boundary."""

import gzip
import hashlib

import pytest

from evtlake.llm import warc


def record(version, kind, name, block, **more):
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:{name}>", "WARC-Target-URI": f"http://{name}/", "WARC-Date": "2024-01-01T00:00:00Z", **{k.replace("_", "-"): v for k, v in more.items()}, "Content-Length": str(len(block))}
    return (f"WARC/{version}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items())).encode() + b"\r\n" + block + b"\r\n\r\n"


def http(page, content="text/html"):
    return f"HTTP/1.1 200 OK\r\nContent-Type: {content}\r\n\r\n".encode() + page


PAGES = {
    "a": ("1.0", http(b"A")),
    "b": ("1.0", http("café".encode("latin-1"), "text/html; charset=ISO-8859-1")),
    "c": ("1.1", http(b"x\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\ny\r\n\r\nWARC/1.1\r\n\r\nz")),  # holds boundaries
    "d": ("1.1", http("<meta charset='windows-1252'>€".encode("cp1252"))),
    "e": ("1.0", http("€".encode() + b"\xff")),
    "f": ("1.1", http(b"ends\r\n\r\n")),
    "g": ("1.0", http("é".encode(), "text/html; charset=no-such")),
    "h": ("1.0", b""),
}
TEXTS = {"a": "A", "b": "café", "c": "x\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\ny\r\n\r\nWARC/1.1\r\n\r\nz", "d": "<meta charset='windows-1252'>€", "e": "€�", "f": "ends\r\n\r\n", "g": "é", "h": ""}


@pytest.mark.parametrize("members", [None, "one", "each"])
def test_responses_of_mixed_versions(spark, tmp_path, members):
    records = [record("1.0", "warcinfo", "i", b"software: x\r\n"), *(record(v, "response", n, b, **({"WARC_Payload_Digest": "sha1:OWN"} if n == "a" else {})) for n, (v, b) in PAGES.items())]
    name = "in.warc" if members is None else "in.warc.gz"
    (tmp_path / name).write_bytes(b"".join(records) if members is None else gzip.compress(b"".join(records)) if members == "one" else b"".join(map(gzip.compress, records)))
    got = {r["record_id"].removeprefix("urn:"): r for r in warc.read_responses(spark, str(tmp_path / name)).collect()}
    assert {n: r["payload"] for n, r in got.items()} == TEXTS
    for n, (_, block) in PAGES.items():
        payload = block.partition(b"\r\n\r\n")[2]
        assert got[n]["payload_digest"] == ("sha1:OWN" if n == "a" else f"sha1:{hashlib.sha1(payload).hexdigest()}")
    made = {(r["refers_to"], r["warc_type"]): r for r in warc.derivatives(warc.read_responses(spark, str(tmp_path / name))).collect()}
    assert len(made) == 2 * len(PAGES) and made["urn:b", "conversion"]["block"] == "café" and made["urn:a", "metadata"]["source_digest"] == "sha1:OWN"
    assert all(r["complete"] for r in warc.read_records(spark, str(tmp_path / name)).collect())


def test_round_trip_by_bytes(spark, tmp_path):
    records = b"".join(record(v, "response", n, b) for n, (v, b) in PAGES.items())
    (tmp_path / "in.warc").write_bytes(records)
    made = warc.derivatives(warc.read_responses(spark, str(tmp_path / "in.warc")))
    warc.write_records(made, str(tmp_path / "out"))
    again = {r["fields"]["warc-record-id"].strip("<>"): r for r in warc.read_records(spark, str(tmp_path / "out")).collect()}
    for w in made.collect():
        r = again[w["record_id"]]
        assert bytes(r["block"]).decode() == w["block"] and len(r["block"]) == w["content_length"] == int(r["fields"]["content-length"])
        assert r["fields"]["warc-block-digest"] == w["block_digest"] == f"sha1:{hashlib.sha1(r['block']).hexdigest()}"
    raw = warc.read_records(spark, str(tmp_path / "in.warc")).selectExpr("fields['warc-record-id'] AS record_id", "'response' AS warc_type", "'' AS refers_to", "'' AS target_uri", "'' AS date", "'' AS block_digest", "'' AS source_digest", "'' AS source_headers", "'' AS content_type", "CAST(octet_length(block) AS BIGINT) AS content_length", "block")
    warc.write_records(raw, str(tmp_path / "raw"), "none")
    assert sorted(bytes(r["block"]) for r in warc.read_records(spark, str(tmp_path / "raw")).collect()) == sorted(b for _, b in PAGES.values())


def test_broken_files(spark, tmp_path):
    whole = record("1.0", "response", "a", http(b"A")) + record("1.0", "response", "b", http(b"B" * 50))
    for name, data in (("cut.warc", whole[:-30]), ("odd.warc", b"WARC/1.0\r\nWARC-Type: response\r\nno colon\r\nX-Long: a\r\n b\r\nContent-Length: ?\r\n\r\nbody"), ("empty.warc", b"")):
        (tmp_path / name).write_bytes(data)
    cut = {r["fields"]["warc-record-id"]: r for r in warc.read_records(spark, str(tmp_path / "cut.warc")).collect()}
    assert cut["<urn:a>"]["complete"] and not cut["<urn:b>"]["complete"]
    odd = warc.read_records(spark, str(tmp_path / "odd.warc")).first()
    assert bytes(odd["block"]) == b"body" and odd["fields"]["x-long"] == "a b" and odd["complete"]
    assert warc.read_responses(spark, str(tmp_path / "empty.warc")).count() == 0
