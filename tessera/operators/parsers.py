"""Definitions, references and inheritance from source text, as Arrow batches of one row per finding.

Python sources go through the standard library's syntax tree, those of the other languages through tokens and brackets.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.operators import lexer

FOUND = "file_path string, what string, kind string, name string, start_line int, end_line int, within string, signature string, qualifier string"

Row = lexer.Row


def _named(name: str | None) -> bool:
    return lexer.kept(name)


def _python(text: str) -> list[Row]:
    lines = text.splitlines()
    out: list[Row] = []

    def name_of(node: ast.AST) -> str | None:
        return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None

    def visit(node: ast.AST, within: str | None, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                is_class = isinstance(child, ast.ClassDef)
                kind = "class" if is_class else "method" if in_class else "function"
                end = child.end_lineno or child.lineno
                out.append(("def", kind, child.name, child.lineno, end, within, lines[child.lineno - 1].strip(), None))
                bases = [name for base in child.bases if (name := name_of(base))] if is_class else []
                for name in bases or ([None] if is_class else []):
                    out.append(("impl", "implements", name, child.lineno, end, child.name, None, None))
                visit(child, child.name, is_class)
                continue
            if isinstance(child, ast.Call) and _named(name := name_of(child.func)):
                owner = name_of(child.func.value) if isinstance(child.func, ast.Attribute) else None
                out.append(("ref", "calls", name, child.lineno, child.lineno, within, None, owner if owner and owner[0].isupper() else None))
            elif isinstance(child, ast.Name) and child.id[0].isupper() and _named(child.id) and not (isinstance(node, ast.Call) and node.func is child):
                out.append(("ref", "references", child.id, child.lineno, child.lineno, within, None, None))
            visit(child, within, in_class and not isinstance(child, ast.expr))

    visit(ast.parse(text), None, False)
    return out


def parse(text: str, language: str | None) -> list[Row]:
    """(what: def, ref, impl or skipped; kind, name, first and last line, enclosing definition, signature, qualifier)."""
    try:
        if language == "python":
            return _python(text)
        return lexer.rows(text, language) if language in lexer.LANGUAGES else []
    except (SyntaxError, ValueError, RecursionError):
        return [("skipped", "", "", 0, 0, None, None, None)]


def parsed(files: DataFrame) -> DataFrame:
    """Findings of every file. files: file_path, language, text. Unparsable files give one `skipped` row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(path, *row) for path, language, text in zip(*[batch.column(c).to_pylist() for c in ("file_path", "language", "text")], strict=True) for row in parse(text or "", language)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 9
            types = [pa.string()] * 4 + [pa.int32()] * 2 + [pa.string()] * 3
            names = ["file_path", "what", "kind", "name", "start_line", "end_line", "within", "signature", "qualifier"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return files.select("file_path", "language", "text").mapInArrow(run, FOUND)


def kept_references(found: DataFrame) -> DataFrame:
    """References inside a definition; those outside every one make no edge."""
    return found.filter("what = 'ref' and within is not null")
