"""Prompt templates: {{ name.path | filter }}, {% for x in name %}, {% if name %}, {# comment #}.

A template is parsed once for each Python worker and rendered for each row's variables, a JSON object. Undefined variables
are errors, extra ones are ignored. Results are structs (text, error), so that one row's error harms no other.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_RENDERED = 1_000_000
_PIECE = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.DOTALL)
_PATH = re.compile(r"[A-Za-z_]\w*(?:\.\w+|\[\d+\]|\['[^']*'\])*")
_STEP = re.compile(r"\.(\w+)|\[(\d+)\]|\['([^']*)'\]")
_FILTERS = {
    "upper": lambda v: _shown(v).upper(), "lower": lambda v: _shown(v).lower(), "trim": lambda v: _shown(v).strip(), "length": len,
    "first": lambda v: v[0], "last": lambda v: v[-1], "tojson": lambda v: json.dumps(v, ensure_ascii=False), "join": lambda v: "".join(map(_shown, v)),
}


class TemplateError(ValueError):
    pass


def _shown(value: Any) -> str:
    return value if isinstance(value, str) else str(value)


def _expression(source: str) -> tuple[str, list[str]]:
    path, *filters = [p.strip() for p in source.split("|")]
    if not _PATH.fullmatch(path) and not re.fullmatch(r"'[^']*'|\"[^\"]*\"|-?\d+(?:\.\d+)?", path):
        raise TemplateError(f"no expression: {source.strip()!r}")
    for f in filters:
        if f not in _FILTERS:
            raise TemplateError(f"no filter named {f!r}")
    return path, filters


@lru_cache(maxsize=1000)
def parsed(source: str) -> tuple:
    """Nested nodes ('text', s), ('value', expression), ('for', name, expression, body), ('if', [(negated, expression or None, body)])."""
    stack: list[tuple[str, list]] = [("", [])]
    at = 0
    for m in _PIECE.finditer(source):
        stack[-1][1].append(("text", source[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            stack[-1][1].append(("value", _expression(m[1])))
        elif m[2] is not None:
            word, _, rest = m[2].strip().partition(" ")
            negated, rest = rest.strip().startswith("not "), rest.strip().removeprefix("not ")
            if word == "for":
                name, found, over = rest.partition(" in ")
                if not found or not name.strip().isidentifier():
                    raise TemplateError(f"no loop: {rest!r}")
                body: list = []
                stack[-1][1].append(("for", name.strip(), _expression(over), body))
                stack.append(("for", body))
            elif word == "if":
                branches = [(negated, _expression(rest), [])]
                stack[-1][1].append(("if", branches))
                stack.append(("if", branches[0][2]))
            elif word in ("elif", "else") and stack[-1][0] == "if":
                stack.pop()
                branches = stack[-1][1][-1][1]
                branches.append((negated, _expression(rest) if word == "elif" else None, []))
                stack.append(("if", branches[-1][2]))
            elif word in ("endfor", "endif") and stack[-1][0] == word[3:]:
                stack.pop()
            else:
                raise TemplateError(f"unexpected {word!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    rest = re.search(r"\{[{%#]", source[at:])
    if rest:
        raise TemplateError("a tag is not closed")
    stack[0][1].append(("text", source[at:]))
    return tuple(stack[0][1])


def _value(expression: tuple[str, list[str]], scope: dict[str, Any]) -> Any:
    path, filters = expression
    if path[0] in "'\"":
        value: Any = path[1:-1]
    elif path[0] in "-0123456789":
        value = json.loads(path)
    else:
        name = re.match(r"\w+", path)[0]
        if name not in scope:
            raise TemplateError(f"{name!r} is undefined")
        value = scope[name]
        for m in _STEP.finditer(path, len(name)):
            key = int(m[2]) if m[2] else m[1] or m[3]
            try:
                value = value[key]
            except (KeyError, IndexError, TypeError):
                raise TemplateError(f"{path!r} is undefined") from None
    for f in filters:
        value = _FILTERS[f](value)
    return value


def _rendered(nodes, scope: dict[str, Any], out: list[str]) -> None:
    for node in nodes:
        if node[0] == "text":
            out.append(node[1])
        elif node[0] == "value":
            out.append(_shown(_value(node[1], scope)))
        elif node[0] == "for":
            items = _value(node[2], scope)
            for i, item in enumerate(items):
                _rendered(node[3], {**scope, node[1]: item, "loop": {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(items) - 1}}, out)
        else:
            for negated, expression, body in node[1]:
                if expression is None or bool(_value(expression, scope)) != negated:
                    _rendered(body, scope, out)
                    break


def rendered(source: str, variables: dict[str, Any]) -> str:
    out: list[str] = []
    _rendered(parsed(source), variables, out)
    text = "".join(out)
    if len(text) > MAX_RENDERED:
        raise TemplateError(f"rendered text exceeds {MAX_RENDERED} characters")
    return text


def variables(sources: list[str]) -> list[str]:
    """The variables that templates take, in alphabetical order; loop variables are none."""
    found: set[str] = set()

    def visit(nodes, local: frozenset[str]) -> None:
        def use(expression) -> None:
            if expression and expression[0][0] not in "'\"-0123456789" and (name := re.match(r"\w+", expression[0])[0]) not in local:
                found.add(name)

        for node in nodes:
            if node[0] == "value":
                use(node[1])
            elif node[0] == "for":
                use(node[2])
                visit(node[3], local | {node[1], "loop"})
            elif node[0] == "if":
                for _, expression, body in node[1]:
                    use(expression)
                    visit(body, local)

    for source in sources:
        visit(parsed(source), frozenset())
    return sorted(found)


@F.pandas_udf(T.StructType().add("text", T.StringType()).add("error", T.StringType()))
def render(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Of template and variables (a JSON object): the text, or why there is none."""
    for sources, values in batches:
        rows = []
        for source, value in zip(sources, values, strict=True):
            try:
                rows.append((rendered(source or "", json.loads(value or "{}")), None))
            except Exception as e:  # a filter may raise anything; the row's error is its result
                rows.append((None, str(e)))
        yield pd.DataFrame(rows, columns=["text", "error"])


@F.pandas_udf(T.StructType().add("variables", T.ArrayType(T.StringType())).add("error", T.StringType()))
def template_variables(sources: pd.Series) -> pd.DataFrame:
    """The variables of each template, or why it cannot be parsed."""
    rows = []
    for source in sources:
        try:
            rows.append((variables([source or ""]), None))
        except TemplateError as e:
            rows.append((None, str(e)))
    return pd.DataFrame(rows, columns=["variables", "error"])
