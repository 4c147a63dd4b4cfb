"""The few functions built-in expressions cannot say, as Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: how elements, their attributes and the parts of a selector are written
OPENING = re.compile(r"<([a-zA-Z][\w\-:]*)(?:\s[^<>]*)?>")
ATTRIBUTE = re.compile(r"""(?<![\w\-:.])([\w\-:.]++)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
PART = re.compile(r"""(?P<tag>[a-zA-Z][\w\-]*)|\#(?P<id>[\w\-]+)|\.(?P<cls>[\w\-]+)|\[(?P<test>[^\]]*)\]""")
TEST = re.compile(r"""([\w\-:]+)(?:\s*([~^$*|]?=)\s*["']?([^\]"']*)["']?)?$""")
# --- fixed values: elements without content
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}

TESTS = {"": lambda have, want: True, "=": str.__eq__, "^=": str.startswith, "$=": str.endswith}
PART_ORDER = ["tag", "id", "cls", "test"]


@dataclass(frozen=True)
class Step:
    """One blank-separated part of a selector as a list of tests on (name, attributes); ``hook``: (kind, value) of one that an element must bear."""

    tests: tuple
    hook: tuple = ("", "")

    def fits(self, name: str, attrs: dict) -> bool:
        for test in self.tests:
            if not test(name, attrs):
                return False
        return True


def _test(kind: str, text: str):
    if kind == "tag":
        return lambda name, attrs: name == text.lower()
    if kind == "id":
        return lambda name, attrs: attrs.get("id") == text
    if kind == "cls":
        return lambda name, attrs: text in attrs.get("class", "").split()
    key, op, want = TEST.match(text).groups(default="")
    compare = TESTS.get(op, str.__contains__)
    return lambda name, attrs: (bool(op) or key.lower() in attrs) and compare(attrs.get(key.lower(), ""), want)


@lru_cache(maxsize=4096)
def compile_selector(selector: str) -> tuple[Step, ...] | None:
    """Steps of a simple selector (tag, #id, .class, [attr op value], blanks), None when it is not one."""
    steps = []
    for word in selector.split():
        parts, at = [], 0
        while at < len(word):
            hit = PART.match(word, at)
            if not hit:
                return None
            parts.append((hit.lastgroup, hit.group(hit.lastgroup)))
            at = hit.end()
        kinds = [PART_ORDER.index(k) for k, _ in parts]
        if kinds != sorted(kinds) or kinds.count(0) > 1 or kinds.count(1) > 1:
            return None
        # an id or a class is rarer than a tag
        hook = max(((k, t.lower() if k == "tag" else t) for k, t in parts if k != "test"), key=lambda p: ["tag", "cls", "id"].index(p[0]), default=("", ""))
        steps.append(Step(tuple(_test(k, t) for k, t in parts if k != "test" or TEST.match(t)), hook))
    return tuple(steps) or None


def elements(page: str):
    """(name, attributes, where its content starts) of every opening tag, in order."""
    for tag in OPENING.finditer(page):
        attrs: dict = {}
        if "=" in tag.group():
            for key, *values in ATTRIBUTE.findall(page, tag.start(), tag.end()):
                attrs.setdefault(key.lower(), next(filter(None, values), ""))
        yield tag.group(1).lower(), attrs, tag.end()


@lru_cache(maxsize=4096)
def _plan(wanted: tuple[tuple[str, str], ...]) -> tuple[dict, dict]:
    """Steps under the kind and value of their hooks as (step, number in ``wanted``, attribute, is it the last one), and the earlier steps of each selector that has some."""
    hooks: dict = {"tag": {}, "id": {}, "cls": {}, "": {}}
    ahead: dict = {}
    for i, (selector, attr) in enumerate(wanted):
        steps = compile_selector(selector)
        if steps and steps[:-1]:
            ahead[i] = steps[:-1]
        for step in steps or ():
            kind, value = step.hook
            hooks[kind][value] = hooks[kind].get(value, ()) + ((step, i, attr, step is steps[-1]),)
    return hooks, ahead


def find_all(page: str, wanted: Sequence[tuple[str, str]], unclosed: int = 0) -> list[list[str]]:
    """For every (selector, attribute) the attribute values, or texts, of the matching elements; the page is read once.

    An ancestor step only has to occur earlier. ``unclosed``: characters of text taken from an element that is never closed, 0 for all.
    """
    out: list[list[str]] = [[] for _ in wanted]
    hooks, earlier = _plan(tuple(wanted))
    tags, ids, classes, anywhere = hooks["tag"], hooks["id"], hooks["cls"], hooks[""].get("", ())
    ahead = {i: set(steps) for i, steps in earlier.items()}
    folded = None
    for name, attrs, start in elements(page) if tags or ids or classes or anywhere else ():
        near = tags.get(name, ()) + anywhere
        if attrs:
            near += ids.get(attrs.get("id"), ())
            for word in set(attrs.get("class", "").split()):
                near += classes.get(word, ())
        if not near:
            continue
        met = [one for one in near if one[0].fits(name, attrs)]
        for _, i, attr, last in met:
            if not last or ahead.get(i):
                continue
            if attr == "text":
                folded = page.lower() if folded is None else folded
                end = start if name in VOID else folded.find(f"</{name}", start)
                end = end if end >= 0 else start + unclosed if unclosed else len(page)
                out[i].append(re.sub(r"<[^>]+>", " ", page[start:end]).strip())
            elif value := attrs.get(attr) or (attrs.get("data-srcset") if attr == "srcset" else None):
                out[i].append(value)
        for step, i, _, last in met:
            if not last:
                ahead[i].discard(step)
    return out


def find_values(page: str, selector: str, attr: str) -> list[str]:
    return find_all(page, [(selector, attr)])[0]


@F.pandas_udf(T.ArrayType(T.StringType()))
def select_values(pages: pd.Series, selectors: pd.Series, attrs: pd.Series) -> pd.Series:
    return pd.Series([find_values(p or "", s or "", (a or "src").lower()) for p, s, a in zip(pages, selectors, attrs)])


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def select_lists(pages: pd.Series, selectors: pd.Series, attrs: pd.Series) -> pd.Series:
    """As ``select_values`` for a list of selectors and a list of attributes, in one pass over each page."""
    return pd.Series([find_all(p or "", [(s or "", (a or "src").lower()) for s, a in zip(many, names)]) for p, many, names in zip(pages, selectors, attrs)])


@lru_cache(maxsize=64)
def lists_of(wanted: tuple[tuple[str, str], ...]):
    """As ``select_lists`` for selectors and attributes that are the same for all pages: a function of a page column."""
    @F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
    def lists(pages: pa.Array) -> pa.Array:
        return pa.array([find_all(p or "", wanted) for p in pages.to_pylist()], pa.list_(pa.list_(pa.string())))

    return lists


@F.pandas_udf(T.StringType())
def decode_bytes(bodies: pd.Series, charsets: pd.Series) -> pd.Series:
    """Declared charset first, then UTF-8, GB18030, Big5, at last Latin-1."""
    def one(raw, declared):
        if raw is None:
            return None
        raw = bytes(raw)
        if declared:
            try:
                return raw.decode(declared, "replace")
            except LookupError:
                pass
        for name in ("utf-8", "gb18030", "big5"):
            try:
                return raw.decode(name)
            except UnicodeDecodeError:
                continue
        return raw.decode("latin-1")

    return pd.Series([one(r, c) for r, c in zip(bodies, charsets)])


@F.pandas_udf(T.StringType())
def regex_problem(patterns: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """'' for a usable or absent pattern, else the message."""
    known: dict = {}

    def check(pattern):
        if not pattern:
            return ""
        if pattern not in known:
            try:
                re.compile(pattern)
                known[pattern] = ""
            except re.error as exc:
                known[pattern] = str(exc)
        return known[pattern]

    for batch in patterns:
        yield batch.map(check)
