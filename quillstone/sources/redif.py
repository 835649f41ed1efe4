"""ReDIF records: ``Field: value`` lines, continuation lines, a blank line ends a record."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


def records(text: str) -> Iterator[dict[str, str]]:
    """The records of a file; repeated fields are joined by ``"; "``, field names are lower case with underscores."""
    fields: dict[str, list[str]] = {}
    last = None
    for line in [*text.splitlines(), ""]:
        if not line.strip():
            if fields:
                yield {k: "; ".join(v) for k, v in fields.items()}
            fields, last = {}, None
        elif line[0].isspace():
            if last:
                fields[last][-1] = f"{fields[last][-1]} {line.strip()}".strip()
        elif ":" in line:  # any other line is no field and is left out
            name, _, value = line.partition(":")
            if name.strip():
                last = name.strip().lower().replace("-", "_")
                fields.setdefault(last, []).append(value.strip())


@udtf(returnType="record int, fields map<string,string>")
class ParseRedif:
    def eval(self, text: str):  # noqa: ANN201
        for i, fields in enumerate(records(text or "")):
            yield i, fields


def read_redif(spark: SparkSession, path: str) -> DataFrame:
    """``file, record, fields`` of all files below a folder."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{rdf,redif,RDF,REDIF}").text(path, wholetext=True)
    rows = files.select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"))
    spark.udtf.register("parse_redif", ParseRedif)
    rows.createOrReplaceTempView("quillstone_redif_files")
    return spark.sql("SELECT file, record, fields FROM quillstone_redif_files, LATERAL parse_redif(text)")
