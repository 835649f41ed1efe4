"""Sinks for reports, arrays, models and self-contained charts; all but the matrix and the model take small, aggregated tables."""

from __future__ import annotations

import html
import io
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import Scratch

#: A report, chart or array file is made on the driver: this many rows at most.
MOST_ROWS = 1_000_000


def _rows(df: DataFrame, most: int) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; aggregate first")
    return rows


def write_report(sections: dict[str, DataFrame | str], path: str, most: int = 10_000) -> None:
    """A text report: each section's title, then its text or its table with aligned columns."""
    out = []
    for title, body in sections.items():
        out += [title, "-" * len(title)]
        if isinstance(body, str):
            out.append(body)
        else:
            table = [body.columns, *[["" if v is None else str(v) for v in r] for r in _rows(body, most)]]
            widths = [max(len(r[i]) for r in table) for i in range(len(body.columns))]
            out += ["  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in table]
        out.append("")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text("\n".join(out), encoding="utf-8")


def write_vectors(df: DataFrame, key: str, array: str, path: str, most: int = MOST_ROWS) -> None:
    """A ``.npy`` matrix in the order of ``key``, which is written beside it as ``.keys.json``."""
    rows = _rows(df.select(key, array).orderBy(key), most)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    np.save(path, np.array([r[array] for r in rows], dtype=np.float64))
    Path(f"{path}.keys.json").write_text(json.dumps([r[key] for r in rows]))


def write_matrix(df: DataFrame, key: str, array: str, path: str) -> None:
    """A ``.npy`` matrix of any number of rows in the order of ``key``, byte for byte what :func:`write_vectors` makes.

    ``path`` is on a file system that driver and executors share.  Rows are sorted by ranges; the ranges' counts tell where each row
    lies, and tasks write their rows there, so no row passes through the driver and a task that is repeated writes the same bytes to
    the same place.  ``<path>.keys`` is a table of ``place, key``.  Arrays of another length than the first, or null, are an error.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("key"), F.col(array).cast("array<double>").alias("v"))
    place = F.monotonically_increasing_id()
    with Scratch(spark, "matrix") as scratch:
        ranged = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key")
        written = scratch.write(ranged.select("key", "v", F.shiftright(place, 33).alias("_range"), place.bitwiseAND(F.lit((1 << 33) - 1).cast("long")).alias("_at")))
        sizes = written.groupBy("_range").agg(F.count("*").alias("n"), F.min(F.coalesce(F.size("v"), F.lit(-1))).alias("least"), F.max(F.coalesce(F.size("v"), F.lit(-1))).alias("most"))
        own = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.withColumn("_before", F.coalesce(F.sum("n").over(own), F.lit(0)))  # a row a range
        n, least, most = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.min("least"), F.max("most")).first()
        if n and (least != most or least < 0):
            raise ValueError(f"arrays of {least} to {most} numbers (-1: null) are no matrix")
        width = most or 0
        head = io.BytesIO()
        np.lib.format.write_array_header_1_0(head, {"descr": "<f8", "fortran_order": False, "shape": (n, width) if n else (0,)})
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        with open(path, "wb") as f:
            f.write(head.getvalue())
            f.truncate(len(head.getvalue()) + n * width * 8)
        first = len(head.getvalue())

        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            done = 0
            with open(path, "r+b") as f:
                for b in batches:
                    at = b.column("place").to_numpy()
                    values = b.column("v").flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(len(at), width)
                    cuts = [0, *(np.flatnonzero(np.diff(at) != 1) + 1).tolist(), len(at)]
                    for x, y in zip(cuts, cuts[1:], strict=False):
                        if x < y:
                            f.seek(first + int(at[x]) * width * 8)
                            f.write(values[x:y].tobytes())
                    done += len(at)
            yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["n"])

        placed = written.join(F.broadcast(starts.select("_range", "_before")), "_range").select((F.col("_before") + F.col("_at")).alias("place"), "key", "v")
        done = placed.select("place", "v").mapInArrow(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if done != n:
            raise RuntimeError(f"{done} of {n} rows were written")
        placed.select("place", "key").write.mode("overwrite").parquet(f"{path}.keys")


def write_model(model: object, path: str) -> None:
    """A fitted pipeline or model in Spark's own format, replacing an older one."""
    model.write().overwrite().save(path)


_PAGE = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{title}</title><style>body{{font-family:sans-serif;margin:2em}}
svg{{width:100%;max-width:960px}}text{{font-size:12px;fill:#333}}.off{{opacity:.1}}button{{margin:0 .5em .5em 0}}</style></head><body><h1>{title}</h1><p>{subtitle}</p><div id="keys"></div><svg id="chart" viewBox="0 0 960 480"></svg>
<script>const S={data};const W=960,H=480,L=70,B=40,T=10;const C=["#1b6ca8","#c8553d","#4f772d","#7b2d8b","#b08900","#3d5a80","#8d0801","#2a9d8f"];
const P=Object.values(S).flat();const X=[Math.min(...P.map(p=>p[0])),Math.max(...P.map(p=>p[0]))],Y=[Math.min(0,...P.map(p=>p[1])),Math.max(...P.map(p=>p[1]))];
const x=v=>L+(v-X[0])/((X[1]-X[0])||1)*(W-L-20),y=v=>H-B-(v-Y[0])/((Y[1]-Y[0])||1)*(H-B-T);let g="";
for(let i=0;i<=5;i++){{const v=Y[0]+(Y[1]-Y[0])*i/5,u=X[0]+(X[1]-X[0])*i/5;g+=`<line x1="${{L}}" x2="${{W-20}}" y1="${{y(v)}}" y2="${{y(v)}}" stroke="#ddd"/><text x="5" y="${{y(v)+4}}">${{v.toPrecision(4)}}</text><text x="${{x(u)-15}}" y="${{H-15}}">${{+u.toFixed(2)}}</text>`}}
Object.entries(S).forEach(([n,p],i)=>{{const c=C[i%C.length];g+=`<g class="s" data-n="${{i}}"><polyline fill="none" stroke="${{c}}" stroke-width="2" points="${{p.map(q=>x(q[0])+","+y(q[1])).join(" ")}}"/>`+p.map(q=>`<circle cx="${{x(q[0])}}" cy="${{y(q[1])}}" r="4" fill="${{c}}"><title>${{q[0]}}: ${{q[1]}}</title></circle>`).join("")+"</g>";
const b=document.createElement("button");b.textContent=n;b.style.color=c;b.onclick=()=>document.querySelector(`g[data-n="${{i}}"]`).classList.toggle("off");document.getElementById("keys").append(b)}});document.getElementById("chart").innerHTML=g;</script></body></html>"""


def write_chart(df: DataFrame, x: str, y: str, path: str, title: str, subtitle: str = "", by: str | None = None, most: int = 20_000) -> None:
    """A line chart as one HTML file without outside parts: points show their values, a series' button hides it."""
    series: dict[str, list[list[float]]] = {}
    for r in _rows(df.select(x, y, *([by] if by else [])).orderBy(x), most):
        if r[x] is not None and r[y] is not None:
            series.setdefault(str(r[by]) if by else y, []).append([float(r[x]), float(r[y])])
    data = json.dumps(series).replace("</", "<\\/")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(_PAGE.format(title=html.escape(title), subtitle=html.escape(subtitle), data=data), encoding="utf-8")


def scope_subtitle(years: tuple[int, int], look_back: int | None = None, new_after: int | None = None) -> str:
    """What a chart covers, in words."""
    parts = [f"Publications {years[0]}-{years[1]}"]
    if look_back is not None:
        parts.append(f"authors ranked by their papers of the {look_back} years before")
    if new_after is not None:
        parts.append(f"an author is new in the first year from {new_after} on")
    return "; ".join(parts)
