"""Upload checks on real archives and files."""

import io
import zipfile

from pyspark.sql import functions as F

from cartulary.config import Settings
from cartulary.functions.archives import has_zip_member
from cartulary.sources.uploads import read_files, validate_uploads


def _archive(names, comment=b"", front=b""):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        for name in names:
            archive.writestr(name, b"text of the member" * 3)
        archive.comment = comment
    return front + held.getvalue()


def test_members_are_read_from_the_directory(spark):
    member = "word/document.xml"
    good = [_archive([member]), _archive(["a", "[Content_Types].xml", member, "z/é.xml"]), _archive([member], b"a comment of the archive"), _archive([member], front=b"#!before")]
    bad = [_archive([]), _archive(["word/document.xml.rels", "xword/document.xml"]), _archive(["a"], member.encode()), member.encode() * 3, b"", None, _archive([member])[:-9], b"PK\x05\x06" + bytes(18)]
    bad.append(_archive([member]).replace(b"PK\x01\x02", b"PK\x01\x00"))
    rows = [(n, x) for n, x in enumerate(good + bad)]
    found = spark.createDataFrame(rows, "n int, content binary").select("n", has_zip_member(F.col("content"), member.encode()).alias("has"))
    assert {r["n"]: r["has"] for r in found.collect()} == {n: n < len(good) for n, _ in rows}


def test_oversize_files_are_not_loaded(spark, tmp_path):
    (tmp_path / "small.pdf").write_bytes(b"%PDF-1.7 text")
    (tmp_path / "large.pdf").write_bytes(b"%PDF-" + b"x" * 5000)
    (tmp_path / "named.docx").write_bytes(_archive(["word/document.xml"]))
    (tmp_path / "mentions.docx").write_bytes(b"word/document.xml")
    limit = Settings(max_upload_size_bytes=1000)
    files = read_files(spark, str(tmp_path), limit)
    assert {r["size_bytes"] for r in files.filter(F.col("content").isNull()).collect()} == {5005}
    checked = validate_uploads(files, limit)
    assert {r["original_filename"]: r["reject_code"] for r in checked.collect()} == {"small.pdf": None, "large.pdf": 413, "named.docx": None, "mentions.docx": 422}
