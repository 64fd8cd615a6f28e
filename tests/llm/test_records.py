"""License scan, Merkle tree and archives."""

import hashlib
import io
import zipfile

import pytest
from plain_texts import awkward, nothing

import __spark_entry__ as entry
from suite.check import actual, connect, differences, expected
from vigil.llm import licenses, merkle, warc

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op2_licenses", "op3_warc", "op4_merkle"])
def test_query_equals_sql(spark, name):
    got = actual(entry.queries()[name](spark, FOLDER))
    problem = differences(got, expected(connect(FOLDER), entry.oracle_sql()[name]))
    assert problem is None, problem


def test_every_operator_is_registered():
    names = {n for n in entry.queries() if n.startswith("op")}
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 14))
    assert "pipeline" in entry.queries()


def test_license_places(spark):
    rows = [(1, "x CC-BY cc by, cc\nBY"), (2, "All rights\treserved. all RIGHTS reserved"), (3, "released under the MIT License"), (4, "cc"), (5, "ccby by cc")]
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (found[1].n_words, found[1].n_base, found[1].first_word, found[1].last_word) == (7, 3, 1, 5)
    assert (found[2].base_labels, found[2].n_base, found[2].last_word) == ("reserved", 2, 3)
    assert (found[3].base_labels, found[3].labels, found[3].score) == ("", "mit", 1.0)
    assert found[4].n_base == found[5].n_base == 0 and found[5].first_word is None


def test_wrapped_notices(spark):
    """Notices over several lines, indented, in comment signs or within running text; words far apart are none."""
    mit = "Permission is hereby granted, free of charge,\n    to any person obtaining\n * a copy of this software"
    bsd = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted"
    filler = " ".join(f"w{i}" for i in range(57))
    rows = [(1, mit), (2, bsd), (3, f"{filler} {mit} {filler}"), (4, f"{filler}\n{bsd}"), (5, f"released under {filler} the mit license"), (6, "")]
    for shift in range(19):
        rows.append((10 + shift, f"{' x' * shift} {bsd}"))
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: r.labels for k, r in found.items() if k < 10} == {1: "mit", 2: "bsd", 3: "mit", 4: "bsd", 5: "", 6: ""}
    assert found[1].score == found[3].score == 1.0 and found[5].score == 0.0
    assert {r.labels for k, r in found.items() if k >= 10} == {"bsd"}


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert licenses.scan(docs).count() == 13 and licenses.scan(nothing(spark)).count() == 0
    assert merkle.edited_pairs(nothing(spark)).count() == 0
    found = merkle.edited_pairs(docs).collect()
    assert len(found) == 13
    prints = {}
    for r in found:
        prints.setdefault((r.doc_id, r.n_chars), set()).add(r.fingerprint)
    assert len(prints[4, 240]) == 1 and prints[4, 240] == prints[5, 240] == prints[None, 240]
    assert {r.near_edited for r in found if r.n_chars == 0} == {1.0}


def test_merkle_of_ids_far_apart(spark):
    rows = [(-5, "a" * 100), (10**12, "b" * 100), (7, "c" * 100), (9 * 10**17, "d" * 100)]
    found = {r.doc_id: r.edited_sha256 for r in merkle.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ordered = sorted(rows)
    for (i, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        assert found[i] == hashlib.sha256((text[:75] + after[:25]).encode()).hexdigest()


def test_branches_locate_edits(spark):
    lines = [f"paragraph number {i} of the text" for i in range(40)]
    changed = [*lines[:12], "inserted", *lines[12:30], "altered", *lines[31:]]
    a = merkle.fingerprints(spark.createDataFrame([(1, "\n".join(lines)), (2, "same")], "doc_id long, text string"))
    b = merkle.fingerprints(spark.createDataFrame([(1, "\n".join(changed)), (2, "same")], "doc_id long, text string"))
    found = {(r.doc_id, r.side, r.paragraph) for r in merkle.differing(a, b).collect()}
    assert found == {(1, "after", 12), (1, "before", 30), (1, "after", 31)}


def package(zip64):
    out = io.BytesIO()
    writer = warc.PackageWriter(out, zip64)
    for name, data in (("archive/data.warc.gz", b"one" * 50), ("indexes/index.cdx", b"0 3\n"), ("leer", b"")):
        writer.begin(name)
        writer.write(data)
        writer.end()
    writer.close()
    return out.getvalue()


@pytest.mark.parametrize("zip64", [False, True])
def test_directory(zip64):
    data = package(zip64)
    with zipfile.ZipFile(io.BytesIO(data)) as file:
        assert file.testzip() is None and file.read("archive/data.warc.gz") == b"one" * 50
    fetch = lambda at, size: data[at : at + size]
    members = {m.name: m for m in warc.directory(fetch, len(data))}
    assert list(members) == ["archive/data.warc.gz", "indexes/index.cdx", "leer"]
    at = warc.member_start(fetch, members["indexes/index.cdx"])
    assert data[at : at + 4] == b"0 3\n"


def test_directory_of_others_files():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as file:
        file.writestr("a", "plain")
        file.writestr("b", "squeezed", compress_type=zipfile.ZIP_DEFLATED)
        file.comment = b"PK\x05\x06 is no end here"
    data = out.getvalue()
    fetch = lambda at, size: data[at : at + size]
    a, b = warc.directory(fetch, len(data))
    assert data[warc.member_start(fetch, a) :][:5] == b"plain"
    with pytest.raises(ValueError, match="compressed"):
        warc.member_start(fetch, b)
    with pytest.raises(ValueError, match="not a whole"):
        warc.directory(lambda at, size: data[:-30][at : at + size], len(data) - 30)


@pytest.mark.parametrize("zip64", [False, True])
def test_archive_round_trip(spark, zip64):
    big, other = "ä" * 700, "b" * 1000
    rows = [(1, "http://x/ä%20", big), (2, None, big), (2, "u", big), (3, "u", other), (4, "u", None), (5, "u", ""), (6, "u", "kurz"), (7, "u", "kurz"), (None, "u", other), (8, "http://x/?a=1#b", big)]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, digest int, refers_to string")
    found = warc.read_back(warc.archive(spark, pages, package_bytes=600, zip64=zip64)).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.url) for r in found), key=str)
    newest = {big: 8, other: 3}
    want = []
    for i, url, html in rows:
        data = (html or "").encode()
        again = len(data) >= 1000 and i != newest[html]
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", newest[html] if again else None, url or ""))
    assert got == sorted(want, key=str)
    assert len({r.package for r in found}) > 1


def test_no_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_back(warc.archive(spark, empty)).count() == 0
