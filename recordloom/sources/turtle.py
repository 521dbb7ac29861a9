"""Turtle text to triples, and back."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"

#: Tokens of Turtle.  A comment ends with its line or, where line breaks were lost, before the next term.
TOKEN = re.compile(
    r'"""(?P<l3>(?:[^"\\]|\\.|"(?!""))*)"""|\'\'\'(?P<s3>(?:[^\'\\]|\\.|\'(?!\'\'))*)\'\'\'|"(?P<l1>(?:[^"\\\n\r]|\\.)*)"|\'(?P<s1>(?:[^\'\\\n\r]|\\.)*)\''
    r"|<(?P<iri>[^>\s]*)>|(?P<comment>#[^\n<\"@]*)|(?P<type>\^\^)|@(?P<at>[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<stop>[;,\[\]()]|\.(?=\s|$))"
    r"|(?P<word>[^\s<>\"';,()\[\]]*[^\s<>\"';,()\[\].])",
    re.S,
)
_ESCAPES = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
_SIMPLE = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    return _ESCAPES.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _SIMPLE.get(m[3], m[3]), text)


def tokenise(turtle: str) -> Iterator[tuple[str, str]]:
    """(kind, text) without comments; kinds: text, iri, word, at, type, stop."""
    for m in TOKEN.finditer(turtle):
        kind = m.lastgroup
        if kind in ("l3", "s3", "l1", "s1"):
            yield "text", unescape(m[kind])
        elif kind != "comment":
            yield kind, m[kind]


class TurtleError(ValueError):
    """The text is not Turtle."""


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = list(tokenise(text)), 0
        self.prefixes: dict[str, str] = {}
        self.base, self.blanks, self.out = "", 0, []

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, kind: str | None = None, text: str | None = None) -> str:
        k, t = self.peek()
        if kind is not None and k != kind or text is not None and t != text:
            raise TurtleError(f"expected {text or kind}, found {t or k}")
        self.at += 1
        return t

    def expand(self, word: str) -> str:
        head, colon, tail = word.partition(":")
        if not colon or head not in self.prefixes:
            raise TurtleError(f"unknown prefix in {word}")
        return self.prefixes[head] + re.sub(r"\\(.)", r"\1", tail)

    def resolve(self, iri: str) -> str:
        iri = unescape(iri)
        return iri if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", iri) else self.base + iri

    def blank(self) -> tuple[str, str]:
        self.blanks += 1
        return f"_:b{self.blanks - 1}", "bnode"

    def parse(self) -> list[tuple]:
        names: dict[str, str] = {}
        self.names = names
        while self.peek()[0] != "end":
            kind, text = self.peek()
            if kind == "at" and text in ("prefix", "base") or kind == "word" and text.lower() in ("prefix", "base"):
                self.take()
                if text.lower() == "prefix":
                    name = self.take("word").removesuffix(":")
                    self.prefixes[name] = self.resolve(self.take("iri"))
                else:
                    self.base = self.resolve(self.take("iri"))
                if kind == "at":
                    self.take("stop", ".")
                continue
            only = text == "["
            subject = self.term()
            if not (only and self.peek() == ("stop", ".")):
                self.properties(subject)
            self.take("stop", ".")
        return self.out

    def properties(self, subject: tuple[str, str]) -> None:
        while True:
            kind, text = self.peek()
            predicate = RDF + "type" if kind == "word" and text == "a" else None
            if predicate:
                self.take()
            elif kind == "iri":
                predicate = self.resolve(self.take())
            elif kind == "word":
                predicate = self.expand(self.take())
            else:
                raise TurtleError(f"expected a predicate, found {text or kind}")
            while True:
                o, o_kind, datatype, lang = self.object()
                self.out.append((*subject, predicate, o, o_kind, datatype, lang))
                if self.peek() != ("stop", ","):
                    break
                self.take()
            while self.peek() == ("stop", ";"):
                self.take()
                more = True
                if self.peek() != ("stop", ";"):
                    break
            else:
                more = False
            if not more or self.peek() in (("stop", "."), ("stop", "]")):
                return

    def term(self) -> tuple[str, str]:
        kind, text = self.peek()
        self.take()
        if kind == "iri":
            return self.resolve(text), "iri"
        if kind == "word" and text.startswith("_:"):
            if text not in self.names:
                self.names[text] = self.blank()[0]
            return self.names[text], "bnode"
        if kind == "word":
            return self.expand(text), "iri"
        if (kind, text) == ("stop", "["):
            node = self.blank()
            if self.peek() != ("stop", "]"):
                self.properties(node)
            self.take("stop", "]")
            return node
        if (kind, text) == ("stop", "("):
            items = []
            while self.peek() != ("stop", ")"):
                items.append(self.object())
            self.take()
            head = (RDF + "nil", "iri")
            for item in reversed(items):
                node = self.blank()
                self.out.append((*node, RDF + "first", *item))
                self.out.append((*node, RDF + "rest", *head, None, None))
                head = node
            return head
        raise TurtleError(f"expected a term, found {text or kind}")

    def object(self) -> tuple[str, str, str | None, str | None]:
        kind, text = self.peek()
        if kind == "text":
            self.take()
            nxt, tag = self.peek()
            if nxt == "type":
                self.take()
                return text, "literal", self.term()[0], None
            if nxt == "at":
                self.take()
                return text, "literal", None, tag.lower()
            return text, "literal", None, None
        if kind == "word" and text in ("true", "false"):
            self.take()
            return text, "literal", XSD + "boolean", None
        if kind == "word" and re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text):
            self.take()
            return text, "literal", XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer"), None
        return (*self.term(), None, None)


def parse(text: str) -> list[tuple]:
    """(s, s_kind, p, o, o_kind, datatype, lang) of a document; `TurtleError` if it is none.

    ``xsd:string`` counts as no datatype.
    """
    return [(*t[:5], None if t[5] == XSD + "string" else t[5], t[6]) for t in _Parser(text).parse()]


SCHEMA = "file string, ord bigint, s string, s_kind string, p string, o string, o_kind string, datatype string, lang string, error string"


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for file, text in zip(batch["file"], batch["text"]):
            if text is None:
                continue
            try:
                rows += [(file, i, *t, None) for i, t in enumerate(parse(text))]
            except (TurtleError, RecursionError, OverflowError, ValueError) as e:
                rows.append((file, None, None, None, None, None, None, None, None, str(e)[:200]))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"ord": "Int64"})


def scan(documents: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """Triples of Turtle documents; one row with ``error`` for a document that cannot be parsed, never an exception.

    Blank nodes are local to their document: ``(file, s)`` names them.
    """
    return documents.select(F.col(file).cast("string").alias("file"), F.col(text).alias("text")).mapInPandas(_scan, SCHEMA)


def write(triples: DataFrame) -> DataFrame:
    """(s, turtle): one document of sorted statements per subject (columns of `scan`)."""
    def quoted(c: F.Column) -> F.Column:
        out = c
        for char, escape in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            out = F.replace(out, F.lit(char), F.lit(escape))
        return F.concat(F.lit('"'), out, F.lit('"'))

    def node(c: F.Column, kind: F.Column) -> F.Column:
        return F.when(kind == "iri", F.concat(F.lit("<"), c, F.lit(">"))).otherwise(c)

    o = F.when(
        F.col("o_kind") == "literal",
        F.concat(quoted(F.col("o")), F.coalesce(F.concat(F.lit("^^<"), "datatype", F.lit(">")), F.concat(F.lit("@"), "lang"), F.lit(""))),
    ).otherwise(node(F.col("o"), F.col("o_kind")))
    line = F.concat(F.lit("<"), "p", F.lit("> "), o)
    subject = node(F.col("s"), F.col("s_kind"))
    return triples.where(F.col("p").isNotNull()).groupBy("s", "s_kind").agg(F.array_sort(F.collect_set(line)).alias("lines")).select(
        "s", F.concat(subject, F.lit(" "), F.array_join("lines", " ;\n    "), F.lit(" .\n")).alias("turtle")
    )
