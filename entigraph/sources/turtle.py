"""Turtle, TriG and JSON-LD as triples (s, p, o, n), the same that the other syntaxes give.

A file is cut into tokens by one pattern and read token by token, with the prefixes and the base in force at that place.
Literals come without quotes, language and type.  Blank nodes get names that hold the hash of their file, so nodes of
different files never meet and a file read twice gives the same names.  Graph names of TriG are left out: a graph's triples
come like others.  Files are read where they lie, one a row; what is no statement raises an error that names the file.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import Any
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
_TOKEN = re.compile(
    r"""(?P<space>(?:\s+|\#[^\n]*)+)|(?P<iri><[^<>"{}|^`\x00-\x20]*>)"""
    r'''|(?P<text>"""(?:(?:"|"")?(?:[^"\\]|\\.))*"""|\'\'\'(?:(?:'|'')?(?:[^'\\]|\\.))*\'\'\'|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')'''
    r"""|(?P<word>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<number>[+-]?(?:\d+(?:\.\d*)?[eE][+-]?\d+|\.\d+[eE][+-]?\d+|\d*\.\d+|\d+))"""
    r"""|(?P<blank>_:[\w](?:[\w.·-]*[\w·-])?)|(?P<name>(?:[^\W\d_](?:[\w.-]*[\w-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[^\w\s])(?:(?:[\w:.·-]|%[0-9A-Fa-f]{2}|\\[^\w\s])*(?:[\w:·-]|%[0-9A-Fa-f]{2}|\\[^\w\s]))?)?)"""
    r"""|(?P<bare>[A-Za-z]+)|(?P<mark>\^\^|[.;,\[\](){}])""",
    re.S,
)
_ESCAPE = re.compile(r"""\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))""", re.S)
_PLAIN = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


def _unescaped(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _PLAIN.get(m[3], m[3]), text)


def _tokens(text: str) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(text):
        found = _TOKEN.match(text, at)
        if not found:
            raise ValueError(f"no token at {at}: {text[at : at + 30]!r}")
        at = found.end()
        if found.lastgroup != "space":
            yield found.lastgroup, found[0]
    yield "end", ""


class Statements:
    """The triples of one text."""

    def __init__(self, text: str, base: str = ""):
        self.tokens = _tokens(text)
        self.kind, self.value = next(self.tokens)
        self.base, self.prefixes = base, {}
        self.blanks, self.mark = 0, hashlib.sha256(text.encode()).hexdigest()[:12]
        self.found: list[tuple[str, str, str]] = []

    def _next(self) -> str:
        value = self.value
        self.kind, self.value = next(self.tokens, ("end", ""))
        return value

    def _expect(self, mark: str) -> None:
        if self._next() != mark:
            raise ValueError(f"{mark!r} is missing before {self.value!r}")

    def _fresh(self) -> str:
        self.blanks += 1
        return f"_:b{self.mark}.{self.blanks}"

    def _iri(self, token: str) -> str:
        return urljoin(self.base, _unescaped(token[1:-1])) if self.base else _unescaped(token[1:-1])

    def _named(self, token: str) -> str:
        prefix, _, local = token.partition(":")
        if prefix not in self.prefixes:
            raise ValueError(f"prefix {prefix!r} is not known")
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def read(self) -> list[tuple[str, str, str]]:
        while self.kind != "end":
            word = self.value.lower().lstrip("@")
            if self.kind in ("word", "bare") and word in ("prefix", "base"):
                self._directive(word, self._next().startswith("@"))
            elif self.value == "}":
                self._next()
            elif self.value == "{" or self.kind == "bare" and word == "graph":
                self._next()
            else:
                alone = self.value == "["
                subject = self._node()
                if self.value == "{":  # it named a graph
                    continue
                if not alone or self.value not in (".", "}"):
                    self._predicates(subject)
                if self.value != "}":
                    self._expect(".")
        return self.found

    def _directive(self, word: str, dotted: bool) -> None:
        if word == "prefix":
            name = self._next()
            self.prefixes[name[:-1]] = self._iri(self._next())
        else:
            self.base = self._iri(self._next())
        if dotted:
            self._expect(".")

    def _predicates(self, subject: str) -> None:
        while True:
            predicate = _RDF + "type" if self.kind == "bare" and self.value == "a" else None
            if predicate:
                self._next()
            else:
                predicate = self._node()
            while True:
                self.found.append((subject, predicate, self._node()))
                if self.value != ",":
                    break
                self._next()
            if self.value != ";":
                return
            while self.value == ";":
                self._next()
            if self.value in (".", "]", "}"):
                return

    def _node(self) -> str:
        kind, value = self.kind, self._next()
        if kind == "iri":
            return self._iri(value)
        if kind == "name":
            return self._named(value)
        if kind == "blank":
            return f"_:n{self.mark}.{value[2:]}"
        if kind == "number" or kind == "bare" and value in ("true", "false"):
            return value
        if kind == "text":
            quotes = 3 if value[:3] in ('"""', "\'\'\'") else 1
            if self.kind == "word":
                self._next()
            elif self.value == "^^":
                self._next()
                self._node()
            return _unescaped(value[quotes:-quotes])
        if value == "[":
            node = self._fresh()
            if self.value != "]":
                self._predicates(node)
            self._expect("]")
            return node
        if value == "(":
            items = []
            while self.value != ")":
                if self.kind == "end":
                    raise ValueError("a list does not end")
                items.append((self._fresh(), self._node()))
            self._next()
            for i, (cell, item) in enumerate(items):
                self.found.append((cell, _RDF + "first", item))
                self.found.append((cell, _RDF + "rest", items[i + 1][0] if i + 1 < len(items) else _RDF + "nil"))
            return items[0][0] if items else _RDF + "nil"
        raise ValueError(f"{value!r} is no term")


class Linked:
    """The triples of a JSON-LD document whose context is its own: terms, prefixes, vocabulary, base, types and lists."""

    def __init__(self, text: str):
        self.document = json.loads(text)
        self.mark, self.blanks = hashlib.sha256(text.encode()).hexdigest()[:12], 0
        self.found: list[tuple[str, str, str]] = []

    def read(self) -> list[tuple[str, str, str]]:
        for node in self.document if isinstance(self.document, list) else [self.document]:
            self._node(node, {})
        return self.found

    def _context(self, own: Any, outer: dict) -> dict:
        for part in own if isinstance(own, list) else [own]:
            if isinstance(part, str):
                raise ValueError(f"the context {part!r} lies elsewhere")
            outer = outer | (part or {})
        return outer

    def _name(self, term: str, context: dict, word: bool) -> str:
        """The IRI of a term; words without a prefix come from the vocabulary, ids from the base."""
        own = context.get(term) if word else None
        own = own.get("@id") if isinstance(own, dict) else own
        if own and own != term:
            return self._name(own, context, word)
        if term.startswith("_:"):
            return f"_:n{self.mark}.{term[2:]}"
        prefix, colon, local = term.partition(":")
        if colon and not local.startswith("//") and isinstance(context.get(prefix), str):
            return self._name(context[prefix], context, True) + local
        if colon:
            return term
        return context.get("@vocab", "") + term if word else urljoin(context.get("@base", ""), term)

    def _node(self, node: dict, context: dict) -> str:
        if "@context" in node:
            context = self._context(node["@context"], context)
        alias = {v: k for k, v in context.items() if v in ("@id", "@type", "@graph")}
        get = lambda key: node.get(key, node.get(alias.get(key, key)))
        if get("@id") is not None:
            subject = self._name(get("@id"), context, False)
        else:
            self.blanks += 1
            subject = f"_:b{self.mark}.{self.blanks}"
        for kind in _listed(get("@type")):
            self.found.append((subject, _RDF + "type", self._name(kind, context, True)))
        for key, value in node.items():
            if key.startswith("@") or context.get(key) in ("@id", "@type", "@graph") or value is None:
                continue
            predicate = self._name(key, context, True)
            if ":" not in predicate:
                continue  # a word that no context explains says nothing
            about = context.get(key) if isinstance(context.get(key), dict) else {}
            if about.get("@container") == "@list":
                value = {"@list": _listed(value)}
            for item in _listed(value):
                if item is not None:
                    self.found.append((subject, predicate, self._value(item, about, context)))
        for inner in _listed(get("@graph")):
            self._node(inner, context)
        return subject

    def _value(self, item: Any, about: dict, context: dict) -> str:
        if isinstance(item, dict):
            if "@value" in item:
                return _plain(item["@value"])
            if "@list" in item:
                rest = _RDF + "nil"
                for one in reversed(_listed(item["@list"])):
                    self.blanks += 1
                    cell = f"_:b{self.mark}.{self.blanks}"
                    self.found += [(cell, _RDF + "first", self._value(one, about, context)), (cell, _RDF + "rest", rest)]
                    rest = cell
                return rest
            if set(item) == {"@id"}:
                return self._name(item["@id"], context, False)
            return self._node(item, context)
        if isinstance(item, str) and about.get("@type") in ("@id", "@vocab"):
            return self._name(item, context, about["@type"] == "@vocab")
        return _plain(item)


def _listed(value: Any) -> list:
    return value if isinstance(value, list) else [] if value is None else [value]


def _plain(value: Any) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def _read(spark: SparkSession, path: str, parse: Any) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows = parse(bytes(content).decode("utf-8-sig"))
                except ValueError as e:
                    raise ValueError(f"{file}: {e}") from e
                yield pd.DataFrame([(*t, i) for i, t in enumerate(rows)], columns=["s", "p", "o", "n"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "s string, p string, o string, n long")


def read_turtle(spark: SparkSession, path: str, base: str = "") -> DataFrame:
    """Triples of Turtle and TriG files; ``base`` is what relative IRIs start from where a file names none."""
    return _read(spark, path, lambda text: Statements(text, base).read())


def read_json_ld(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, lambda text: Linked(text).read())
