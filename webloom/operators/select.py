"""CSS and path selectors as array expressions over the nodes of a page."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.vectors import bind
from webloom.operators.nodes import TEXT, subtree, text_of


#: Where a step looks from a place: below it, among its children, at its next sibling, at all later siblings.
BELOW, CHILD, NEXT, LATER = " ", ">", "+", "~"


@dataclass(frozen=True)
class Step:
    """One step: where to look, the tag, and predicates that apply in their order.

    Predicates: ``("class", name)``, ``("attr", name, operator, value)``, ``("text", operator, value)`` on an
    own text node, ``("string", operator, value)`` on all text below, ``("not", (predicates))``,
    ``("ix", field, step, offset, from_end)`` on a stored ordinal, and ``("position", n)`` (0: the last) among
    the siblings that the predicates before have left.
    """

    axis: str
    tag: str
    predicates: tuple[tuple, ...] = ()


def _compare(value: Column, how: str, wanted: str) -> Column:
    tests = {"=": lambda: value == wanted, "^=": lambda: value.startswith(wanted), "$=": lambda: value.endswith(wanted),
             "*=": lambda: value.contains(wanted), "~=": lambda: F.array_contains(F.split(value, r"\s+"), wanted), "": lambda: value.isNotNull()}
    return F.coalesce(tests[how](), F.lit(False))


def _is_tag(n: Column, tag: str) -> Column:
    return (n["tag"] != TEXT) if tag in ("*", "") else (n["tag"] == tag.lower())


def _holds(n: Column, nodes: Column, predicate: tuple) -> Column:
    kind, *rest = predicate
    if kind == "tag":
        return _is_tag(n, rest[0])
    if kind == "class":
        return F.array_contains(n["classes"], rest[0])
    if kind == "attr":
        return _compare(F.try_element_at(n["attrs"], F.lit(rest[0])), *rest[1:])
    if kind == "text":
        return F.exists(subtree(nodes, n["node"] + 1, n["end_node"]), lambda c: (c["parent"] == n["node"]) & (c["tag"] == TEXT) & _compare(c["text"], *rest))
    if kind == "string":
        return _compare(text_of(nodes, n["node"], n["end_node"]), *rest)
    if kind == "ix":
        field, every, offset, from_end = rest
        place = (n["n_elements" if field == "element_ix" else "n_same_tag"] - n[field]) if from_end else n[field] + 1
        return (place == offset) if not every else (((place - offset) % every == 0) & ((place - offset) / every >= 0))
    inner = F.lit(True)
    for p in rest[0]:
        inner = inner & _holds(n, nodes, p)
    return ~inner


def _kept(found: Column, nodes: Column, step: Step) -> Column:
    """The nodes that the step's tag and predicates leave, in document order."""
    held: list[tuple] = [("tag", step.tag)]

    def tested(values: Column, tests: list[tuple]) -> Column:
        def test(n: Column) -> Column:
            held = F.lit(True)
            for t in tests:
                held = held & _holds(n, nodes, t)
            return held
        return F.filter(values, test) if tests else values

    for predicate in step.predicates:
        if predicate[0] != "position":
            held.append(predicate)
            continue
        rows = F.array_sort(F.transform(tested(found, held), lambda n: F.struct(n["parent"].alias("parent"), n["node"].alias("node"))))
        found, held = _nth(rows, nodes, predicate[1]), []
    return tested(found, held)


def _nth(rows: Column, nodes: Column, position: int) -> Column:
    """Of rows sorted by parent, the one at the position in each parent's run (0: the last), as nodes."""
    def chosen(s: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(s, i)["parent"] == x["parent"], F.lit(False))
        at = (lambda x, i: ~same(x, i + 1)) if position == 0 else (lambda x, i: same(x, i - position + 1) & ~same(x, i - position))
        return F.transform(F.array_sort(F.transform(F.filter(s, at), lambda x: x["node"])), lambda k: F.get(nodes, k))
    return bind(rows, chosen)


_NAME = r"[\w-]+"
_ATTR = r"\[\s*([\w:-]+)\s*(?:([~^$*]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\"'\]\s]*))\s*)?\]"
_PSEUDO = r":([\w-]+)(?:\(((?:[^()\"']|\"[^\"]*\"|'[^']*')*)\))?"
_TEST = re.compile(rf"([.#])({_NAME})|{_ATTR}|{_PSEUDO}")
_TAG = re.compile(rf"{_NAME}|\*")
_COMBINE = re.compile(r"\s*([>+~])\s*|\s+")
_AXIS = re.compile(r"(//?)([\w-]+|\*)")


def _outside(text: str, mark: str) -> list[str]:
    """Parts between marks that stand outside brackets, parentheses and quotes."""
    parts, depth, quote = [""], 0, ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        else:
            depth += (c in "[(") - (c in "])")
            if c == mark and not depth:
                parts.append("")
                continue
        parts[-1] += c
    return parts


def _nth_child(formula: str) -> tuple[int, int]:
    """(step, offset) of ``odd``, ``even``, ``3``, ``2n+1`` ..."""
    text = {"odd": "2n+1", "even": "2n"}.get(formula.strip().lower(), re.sub(r"\s+", "", formula.lower()))
    hit = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?|([+-]?\d+)", text)
    if hit is None:
        raise ValueError(f"invalid position: {formula}")
    if hit.group(3):
        return 0, int(hit.group(3))
    every = {"": 1, "+": 1, "-": -1}.get(hit.group(1), None)
    return (int(hit.group(1)) if every is None else every), int(hit.group(2) or 0)


def _pseudo(name: str, inside: str | None, selector: str) -> tuple:
    field = "tag_ix" if name.endswith("-of-type") else "element_ix"
    plain = {"first-child": False, "first-of-type": False, "last-child": True, "last-of-type": True}
    if name in plain:
        return "ix", field, 0, 1, plain[name]
    if name in ("nth-child", "nth-of-type", "nth-last-child", "nth-last-of-type") and inside:
        return "ix", field, *_nth_child(inside), "last" in name
    if name == "not" and inside:
        step, end = _compound(inside.strip(), 0, BELOW, selector)
        if end == len(inside.strip()):
            return "not", (("tag", step.tag), *step.predicates)
    raise ValueError(f"invalid selector: {selector}")


def _compound(text: str, at: int, axis: str, selector: str) -> tuple[Step, int]:
    """A tag with its tests, and where they end."""
    hit = _TAG.match(text, at)
    tag, begin = (hit.group(), at) if hit else ("*", at)
    at = hit.end() if hit else at
    tests = []
    while hit := _TEST.match(text, at):
        mark, name, attr, how, a, b, c, pseudo, inside = hit.groups()
        if mark:
            tests.append(("class", name) if mark == "." else ("attr", "id", "=", name))
        elif attr:
            tests.append(("attr", attr.lower(), how or "", a or b or c or ""))
        else:
            tests.append(_pseudo(pseudo.lower(), inside, selector))
        at = hit.end()
    if at == begin:
        raise ValueError(f"invalid selector: {selector}")
    return Step(axis, tag, tuple(tests)), at


def css(selector: str) -> list[list[Step]]:
    """Alternatives of a selector, each a chain of steps."""
    chains = []
    for alternative in _outside(selector, ","):
        text = alternative.strip()
        step, at = _compound(text, 0, BELOW, selector)
        chain = [step]
        while at < len(text):
            hit = _COMBINE.match(text, at)
            if hit is None:
                raise ValueError(f"invalid selector: {selector}")
            step, at = _compound(text, hit.end(), hit.group(1) or BELOW, selector)
            chain.append(step)
        chains.append(chain)
    return chains


def _path_test(inside: str, first: bool, tag: str) -> tuple:
    """One predicate of a path; a position right behind the tag is a stored ordinal."""
    inside = inside.strip()
    field = "element_ix" if tag == "*" else "tag_ix"
    if inside.isdigit():
        return ("ix", field, 0, int(inside), False) if first else ("position", int(inside))
    if inside == "last()":
        return ("ix", field, 0, 1, True) if first else ("position", 0)
    value = r"(?:\"([^\"]*)\"|'([^']*)')"
    what = r"(@[\w:-]+|text\(\)|\.)"
    for pattern, how in ((rf"{what}\s*=\s*{value}", "="), (rf"contains\(\s*{what}\s*,\s*{value}\s*\)", "*="),
                         (rf"starts-with\(\s*{what}\s*,\s*{value}\s*\)", "^=")):
        if hit := re.fullmatch(pattern, inside):
            wanted = hit.group(2) if hit.group(2) is not None else hit.group(3)
            name = hit.group(1)
            return ("attr", name[1:].lower(), how, wanted) if name[0] == "@" else ("text" if name == "text()" else "string", how, wanted)
    if hit := re.fullmatch(r"not\((.*)\)", inside):
        return "not", (_path_test(hit.group(1), first, tag),)
    if hit := re.fullmatch(r"@([\w:-]+)", inside):
        return "attr", hit.group(1).lower(), "", ""
    raise ValueError(f"unsupported test: {inside}")


def xpath(path: str) -> tuple[list[Step], str]:
    """(steps, attribute) of ``//a/b[@x='y'][2]/@href``; attribute empty for text."""
    whole = path
    steps = _outside(path, "/")
    attribute = steps.pop()[1:] if steps[-1].startswith("@") else ""
    path = "/".join(steps).removesuffix("/text()").removeprefix(".")
    chain, at = [], 0
    while at < len(path):
        hit = _AXIS.match(path, at)
        if hit is None:
            raise ValueError(f"unsupported path: {whole}")
        axis, tag = CHILD if hit.group(1) == "/" else BELOW, hit.group(2)
        at, tests = hit.end(), []
        while at < len(path) and path[at] == "[":
            inside = _bracketed(path, at)
            tests.append(_path_test(inside, not tests, tag))
            at += len(inside) + 2
        chain.append(Step(axis, tag, tuple(tests)))
    return chain, attribute


def _bracketed(text: str, at: int) -> str:
    """What stands inside the bracket that opens at ``at``; quotes may hold brackets."""
    quote = ""
    for k in range(at + 1, len(text)):
        c = text[k]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "]":
            return text[at + 1:k]
    raise ValueError(f"unsupported path: {text}")


def _place(n: Column) -> Column:
    return F.struct(n["node"].alias("node"), n["end_node"].alias("end_node"))


ROOT = "named_struct('node', -1, 'end_node', 2147483647)"


def _scope(nodes: Column, p: Column, axis: str) -> Column:
    """Where a step looks from a place."""
    inside = subtree(nodes, F.greatest(p["node"], F.lit(-1)) + 1, F.least(p["end_node"], F.size(nodes)))
    if axis == BELOW:
        return inside
    if axis == CHILD:
        return F.filter(inside, lambda n: n["parent"] == p["node"])
    own = F.get(nodes, p["node"])
    beyond = subtree(nodes, p["end_node"], F.size(nodes))
    later = F.filter(beyond, lambda n: (n["parent"] == own["parent"]) & (n["tag"] != TEXT))
    return F.slice(later, 1, 1) if axis == NEXT else later


def follow(nodes: Column, chain: list[Step], start: Column | None = None) -> Column:
    """Places (node, end_node) that a chain of steps reaches, in document order.

    Each step searches the subtree slices of the places before it, or their later siblings.
    """
    places = start
    for step in chain:
        if places is None:
            # From the page itself: a child step means the roots of the page.
            scope = F.filter(nodes, lambda n: n["parent"] == -1) if step.axis == CHILD else nodes
            places = F.transform(_kept(scope, nodes, step), _place)
        else:
            places = F.array_sort(F.array_distinct(F.flatten(F.transform(
                places, lambda p: F.transform(_kept(_scope(nodes, p, step.axis), nodes, step), _place)))))
    return places


def select(nodes: Column, selector: str) -> Column:
    """Places a CSS selector matches anywhere in the page."""
    found = [follow(nodes, chain) for chain in css(selector)]
    return found[0] if len(found) == 1 else F.array_sort(F.array_distinct(F.concat(*found)))


def within(places: Column, contexts: Column) -> Column:
    """Places inside one of the contexts."""
    return F.filter(places, lambda p: F.exists(contexts, lambda c: (p["node"] > c["node"]) & (p["node"] < c["end_node"])))
