"""RDF ontologies as triples (s, p, o, n): RDF/XML files parsed where they are read, N-Triples by line in the JVM."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RDF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"
_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def _uri(tag: str) -> str:
    return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag


def triples_of(data: bytes) -> Iterator[tuple[str, str, str, int]]:
    """Top-level node elements, their type and properties; nested nodes come as blank nodes."""
    root, n, blanks = ET.fromstring(data), 0, 0
    base = root.get("{http://www.w3.org/XML/1998/namespace}base", "")

    def walk(node: ET.Element) -> Iterator[tuple[str, str, str]]:
        nonlocal blanks
        about = node.get(f"{_RDF}about") or (base + "#" + node.get(f"{_RDF}ID") if node.get(f"{_RDF}ID") else None)
        if about is None:
            blanks += 1
            about = f"_:b{blanks}"
        elif about.startswith("#"):
            about = base + about
        if node.tag != f"{_RDF}Description":
            yield about, _TYPE, _uri(node.tag)
        for child in node:
            resource = child.get(f"{_RDF}resource")
            if resource is not None:
                yield about, _uri(child.tag), base + resource if resource.startswith("#") else resource
            elif len(child):
                for inner in child:
                    rows = list(walk(inner))
                    if rows:
                        yield about, _uri(child.tag), rows[0][0]
                    yield from rows
            else:
                yield about, _uri(child.tag), (child.text or "").strip()

    for node in root:
        for s, p, o in walk(node):
            yield s, p, o, n
            n += 1


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [t for c in pdf["content"] for t in triples_of(bytes(c))]
            yield pd.DataFrame(rows, columns=["s", "p", "o", "n"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "s string, p string, o string, n long")


def n_triples(lines: DataFrame) -> DataFrame:
    """Triples of (value, n), a line of N-Triples each.  Literals come without quotes, language and type; comments,
    blank lines and lines that are no triple are left out."""
    pattern = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*\.\s*(?:#.*)?$'
    bare = lambda c: F.regexp_replace(c, "^<(.*)>$", "$1")
    literal = F.regexp_extract(F.regexp_extract("value", pattern, 3), r'^"((?:[^"\\]|\\.)*)"', 1)
    for code, char in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ('\\"', '"'), ("\\\\", "\\")):
        literal = F.replace(literal, F.lit(code), F.lit(char))
    o = F.regexp_extract("value", pattern, 3)
    return lines.where(F.col("value").rlike(pattern)).select(bare(F.regexp_extract("value", pattern, 1)).alias("s"), F.regexp_extract("value", pattern, 2).alias("p"), F.when(o.startswith('"'), literal).otherwise(bare(o)).alias("o"), "n")


def read_n_triples(spark: SparkSession, path: str) -> DataFrame:
    """Triples of .nt files; ``n`` grows along each file."""
    return n_triples(spark.read.text(path).withColumn("n", F.monotonically_increasing_id()))
