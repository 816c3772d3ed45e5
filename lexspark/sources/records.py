"""Typed records of XML members of archives, and archives that are read by ranges of their members.

An archive is never a row: tar files are indexed by their headers (a task an archive reads 512
bytes a member and skips the rest), members that lie near each other become ranges of bounded size, and each range is
read by a task of its own.  Compressed tar files can't be entered in the middle; those are streamed, member by member."""

from __future__ import annotations

import hashlib
import tarfile

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.operators import reconcile

MEMBER_BYTES = 8 * 1024 * 1024
RANGE_BYTES = 32 * 1024 * 1024
BLOCK = 512
MEMBERS = "path string, member string, bytes long, sha256 string, text string, error string"

# The archive's XML record, its identifiers and the kinds of decisions taken.
RECORD = (
    "META struct<META_COMMUN: struct<ID: string, ORIGINE: string, NATURE: string>, META_SPEC: struct<META_JURI: struct<TITRE: string, DATE_DEC: string, JURIDICTION: string, NUMERO: string, NOR: string>,"
    " META_JURI_CONSTIT: struct<URL_CC: string, ECLI: string, NATURE_QUALIFIEE: string>>>"
)
ROOT, RECORD_ID, ORIGIN, JURISDICTION, NATURES = "TEXTE_JURI_CONSTIT", r"^CONSTEXT\d{12}$", "CONSTIT", "Conseil constitutionnel", ("QPC", "DC")
ECLI, DECISION_URL = r"(?i)^ECLI:FR:CC:", r"^https?://(?:[^@/]*@)?www\.conseil-constitutionnel\.fr(?::\d+)?(/decision/(\d{4})/([^/?#]+)\.html?)(?:[?#].*)?$"


def _open(path: str):
    # binaryFile gives local paths as file:/x, which Arrow reads as file:///x
    found, at = pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path)
    return found.open_input_file(at)


def _safe(name: str) -> bool:
    return bool(name) and len(name) <= 300 and not name.startswith("/") and "\\" not in name and not {".", ".."} & set(name.rstrip("/").split("/"))


def _member(path: str, name: str, size: int, data: bytes | None, error: str | None = None) -> tuple:
    said = None
    if error is None:
        try:
            said = data.decode("utf-8")
        except UnicodeDecodeError:
            error = "encoding_invalid"
    return path, name, size, hashlib.sha256(data).hexdigest() if data is not None else None, said, error


def index(archives: DataFrame, suffix: str = ".xml", most: int = MEMBER_BYTES) -> DataFrame:
    """path, member, offset (of its content), bytes, error of the members of uncompressed tar files (path). Members
    of unsafe names or over ``most`` bytes have an error and aren't read; a file that ends too early or is no tar
    has a row of its own that says so (unreadable)."""

    def run(batches):
        for pdf in batches:
            for path in pdf["path"]:
                rows, seen = [], set()
                try:
                    with _open(path) as f, tarfile.open(fileobj=f, mode="r:") as tar:
                        for m in tar:
                            if not m.isfile() or not m.name.endswith(suffix):
                                continue
                            error = "path_invalid" if not _safe(m.name) else "duplicate_path" if m.name in seen else "too_large" if m.size > most else "empty" if not m.size else None
                            seen.add(m.name)
                            rows.append((path, m.name, m.offset_data, m.size, error))
                            if len(rows) >= 10_000:
                                yield pd.DataFrame(rows, columns=["path", "member", "offset", "bytes", "error"])
                                rows = []
                        f.seek(tar.offset)
                        if f.read(BLOCK) != bytes(BLOCK):  # an archive ends with blocks of zeros
                            rows.append((path, None, None, None, "truncated"))
                except (tarfile.TarError, EOFError, OSError):
                    rows.append((path, None, None, None, "unreadable"))
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "member", "offset", "bytes", "error"]).astype({"offset": "Int64", "bytes": "Int64"})

    return archives.select("path").mapInPandas(run, "path string, member string, offset long, bytes long, error string")


def read_members(members: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, member, bytes, sha256, text, error of indexed members: those of a range of a file are read on end.

    An index row is small and what it leads to is not, so the partitions are a fixed number: by the bytes that are
    shuffled, all of them would be joined to one."""
    placed = members.withColumn("range", F.expr(f"offset div {range_bytes}"))
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = placed.repartition(tasks, "path", "range").sortWithinPartitions("path", "offset")

    def run(batches):
        path, f, rows, size = None, None, [], 0
        names = ["path", "member", "bytes", "sha256", "text", "error"]
        for pdf in batches:
            for p, m, at, n, error in zip(pdf["path"], pdf["member"], pdf["offset"], pdf["bytes"], pdf["error"]):
                if error is not None:
                    rows.append((p, m, None if pd.isna(n) else int(n), None, None, error))
                    continue
                if p != path:
                    if f is not None:
                        f.close()
                    path, f = p, _open(p)
                f.seek(int(at))
                rows.append(_member(p, m, int(n), f.read(int(n))))
                size += int(n)
                if size >= range_bytes:
                    yield pd.DataFrame(rows, columns=names).astype({"bytes": "Int64"})
                    rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names).astype({"bytes": "Int64"})
        if f is not None:
            f.close()

    return rows.select("path", "member", "offset", "bytes", "error").mapInPandas(run, MEMBERS)


def stream_members(archives: DataFrame, suffix: str = ".xml", most: int = MEMBER_BYTES) -> DataFrame:
    """The same of compressed tar files, which are read from their beginning, one member in memory at a time."""

    def run(batches):
        names = ["path", "member", "bytes", "sha256", "text", "error"]
        for pdf in batches:
            for path in pdf["path"]:
                rows, size, seen = [], 0, set()
                try:
                    with _open(path) as f, tarfile.open(fileobj=f, mode="r|*") as tar:
                        for m in tar:
                            if not m.isfile() or not m.name.endswith(suffix):
                                continue
                            error = "path_invalid" if not _safe(m.name) else "duplicate_path" if m.name in seen else "too_large" if m.size > most else "empty" if not m.size else None
                            seen.add(m.name)
                            rows.append(_member(path, m.name, m.size, tar.extractfile(m).read() if error is None else None, error))
                            size += m.size if error is None else 0
                            if size >= most:
                                yield pd.DataFrame(rows, columns=names).astype({"bytes": "Int64"})
                                rows, size = [], 0
                except (tarfile.TarError, EOFError, OSError, ValueError):
                    rows.append((path, None, None, None, None, "unreadable"))
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"bytes": "Int64"})

    return archives.select("path").mapInPandas(run, MEMBERS)


def members(spark: SparkSession, path: str, suffix: str = ".xml", most: int = MEMBER_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The members of all tar files of a path or pattern. Only names of files are read here, never contents."""
    found = spark.read.format("binaryFile").load(path).select("path")
    packed = F.col("path").rlike(r"(?i)\.(gz|tgz|bz2|xz)$")
    return read_members(index(found.where(~packed), suffix, most), range_bytes).unionByName(stream_members(found.where(packed), suffix, most))


def xml_records(rows: DataFrame, xml: str = "text") -> DataFrame:
    """The rows and their XML as columns: record_id, nature, qualified_nature, title, decided, number, ecli, nor, url,
    court_record and error (null: a whole record; other_nature: none that is wanted; else what is wrong first).

    An error that the rows have already stays, and such rows have no record."""
    doc = F.from_xml(F.col(xml), RECORD, {"mode": "PERMISSIVE", "ignoreSurroundingSpaces": "true"})
    common, spec = "r.META.META_COMMUN", "r.META.META_SPEC"
    value = lambda name: F.nullif(F.trim(F.regexp_replace(F.col(name), "[\\s ]+", " ")), F.lit(""))
    fields = {
        "record_id": value(f"{common}.ID"), "origin": value(f"{common}.ORIGINE"), "nature": F.upper(value(f"{common}.NATURE")), "qualified_nature": value(f"{spec}.META_JURI_CONSTIT.NATURE_QUALIFIEE"),
        "title": value(f"{spec}.META_JURI.TITRE"), "day": value(f"{spec}.META_JURI.DATE_DEC"), "court": value(f"{spec}.META_JURI.JURIDICTION"), "number": value(f"{spec}.META_JURI.NUMERO"), "nor": value(f"{spec}.META_JURI.NOR"),
        "ecli": value(f"{spec}.META_JURI_CONSTIT.ECLI"), "link": value(f"{spec}.META_JURI_CONSTIT.URL_CC"),
    }
    x = "record_"
    got = rows.withColumn("r", doc).select(*(c for c in rows.columns if c != "error"), (F.col("error") if "error" in rows.columns else F.lit(None).cast("string")).alias("was"), *(c.alias(x + n) for n, c in fields.items()))
    f = {n: F.col(x + n) for n in fields}
    decided = F.expr(f"try_to_date({x}day, 'yyyy-MM-dd')")
    part = lambda i: F.regexp_extract(f["link"], DECISION_URL, i)
    no = lambda c: ~F.coalesce(c, F.lit(False))
    tests = {
        "xml_missing": F.col(xml).isNull(),
        "entity_forbidden": F.col(xml).rlike("(?i)<!DOCTYPE|<!ENTITY"),
        "root_invalid": no(F.col(xml).rlike(f"^\\s*(?:<\\?xml[^>]*>\\s*)?<{ROOT}[\\s>]") & F.trim(F.col(xml)).endswith(f"</{ROOT}>")),
        "id_missing": f["record_id"].isNull(),
        "origin_missing": f["origin"].isNull(),
        "nature_missing": f["nature"].isNull(),
        "identity_invalid": no(f["record_id"].rlike(RECORD_ID) & (f["origin"] == ORIGIN)),
        "other_nature": no(f["nature"].isin(*NATURES)),
        "date_invalid": no(f["day"].rlike(r"^\d{4}-\d{2}-\d{2}$") & decided.isNotNull()),
        "jurisdiction_invalid": no(f["court"] == JURISDICTION),
        "title_missing": f["title"].isNull(),
        "number_missing": f["number"].isNull(),
        "url_invalid": no((part(2) == F.substring(f["day"], 1, 4)) & F.upper(part(3)).endswith(f["nature"])),
        "ecli_invalid": ~F.coalesce(f["ecli"].rlike(ECLI), F.lit(True)),
    }
    error = F.coalesce(F.col("was"), *(F.when(bad, name) for name, bad in tests.items()))
    got = got.withColumn("error", error)
    whole = lambda c: F.when(F.col("error").isNull(), c)
    made = {n: f[n] for n in ("record_id", "nature", "qualified_nature", "title", "number", "ecli", "nor")} | {"decided": decided, "url": F.concat(F.lit("https://www.conseil-constitutionnel.fr"), part(1)), "court_record": part(3)}
    return got.select(*(c for c in rows.columns if c not in ("error", *made)), *(whole(c).alias(n) for n, c in made.items()), "error")


def once(records: DataFrame) -> DataFrame:
    """Whole records; an id that comes again, in any case, is an error of the later members (by path and name).

    The records are read twice, so they should be written before: a filter on error that moves down to the XML would
    also parse it anew for each of its tests."""
    key = F.lower("record_id")
    first = records.where("error is null").groupBy(key.alias("k")).agg(F.min(F.struct("path", "member")).alias("first"))
    j = records.join(first, key == F.col("k"), "left")
    again = F.col("k").isNotNull() & (F.struct("path", "member") != F.col("first"))
    return j.withColumn("error", F.when(again, "record_duplicate").otherwise(F.col("error"))).drop("k", "first")


def checksum() -> Column:
    """sha256 of a record's fields, for comparing stock and increments."""
    names = ("record_id", "nature", "title", "decided", "number", "ecli", "nor", "url")
    return reconcile.checksum(*names)
