"""Application states embedded in pages, shredded into a flat table of objects while they are parsed.

The parser reports an object when it ends, so what an object holds is numbered before it: the numbers
below an object are a range that ends with its own. An object names its holder, which has a higher
number; facts that pass from holders to what they hold are settled in one pass from the last number down.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from offerloom import rules


class _Object(dict):
    """An object with its number, the first number below it, its holder and the levels between."""

    __slots__ = ("number", "first", "holder", "levels")


def _held(value: object, levels: int) -> Iterator[tuple[_Object, int]]:
    """Objects that a value is or lists, and how many levels down they are."""
    layer = [value]
    while layer:
        yield from ((x, levels) for x in layer if isinstance(x, _Object))
        layer = [x for inner in layer if isinstance(inner, list) for x in inner]
        levels += 1


class State:
    """The objects of one JSON text. Raises what the parser raises."""

    def __init__(self, text: str) -> None:
        self.objects: list[_Object] = []
        self.root = json.JSONDecoder(object_pairs_hook=self._ended).raw_decode(text)[0]
        for top, levels in _held(self.root, 0):
            top.holder, top.levels = -1, levels
        # An object under a key that is stated again later has no holder and is no part of the state.
        self.level: dict[int, int] = {-1: 0}
        for item in reversed(self.objects):
            if item.holder in self.level:
                self.level[item.number] = self.level[item.holder] + item.levels

    def _ended(self, pairs: list) -> _Object:
        item = _Object(pairs)
        item.number = item.first = len(self.objects)
        item.holder, item.levels = None, 0
        for value in item.values():
            for inner, levels in _held(value, 1):
                inner.holder, inner.levels = item.number, levels
                item.first = min(item.first, inner.first)
        self.objects.append(item)
        return item

    def in_order(self) -> list[_Object]:
        """The objects by where they begin; a holder comes before what it holds."""
        kept = (x for x in self.objects if x.number in self.level)
        return sorted(kept, key=lambda x: (x.first, -x.number))


def shredded(text: str) -> State | None:
    """The state of a text; None if it is broken or nested deeper than the parser can follow."""
    try:
        return State(text)
    except (ValueError, RecursionError):
        return None


def embedded(html: str, source: str) -> State | None:
    """The state that one of the source's patterns finds; one page never ends a job."""
    texts = (
        found[1].replace("\\\\", "\\") if escaped else found[1]
        for pattern, escaped in rules.STATE_SOURCES[source]
        if (found := re.search(pattern, html, re.S)) is not None
    )
    return next((state for text in texts if (state := shredded(text)) is not None), None)


def _named(item: _Object, names: tuple[str, ...]) -> bool:
    """Whether one of the item's widget names holds one of the names."""
    own = (next((str(item[k]).lower() for k in keys if item.get(k)), "") for keys in rules.WIDGET_NAMES)
    return any(name in text for text in own for name in names)


def grid_items(state: State | None) -> list[dict]:
    """Listed items of widgets in the main grid, recommendations left out."""
    if state is None:
        return []
    grid: set[int] = set()
    for item in reversed(state.objects):
        level = state.level.get(item.number)
        if level is None or level > rules.STATE_LEVELS or _named(item, rules.SKIP_WIDGETS):
            continue
        if item.holder in grid or _named(item, rules.MAIN_GRID_WIDGETS):
            grid.add(item.number)
    lists = (
        item[key]
        for item in state.in_order()
        if item.number in grid
        for key in rules.STATE_ITEM_LISTS
        if isinstance(item.get(key), list)
    )
    return [entry for entries in lists for entry in entries if isinstance(entry, dict)]


def widget_items(state: State | None) -> list[dict]:
    """Items of the grid widgets among a state's widgets, which are stored as texts or as values."""
    root = state.root if state is not None else None
    widgets = root.get("widgetStates") if isinstance(root, dict) else None
    items: list[dict] = []
    for name, raw in (widgets.items() if isinstance(widgets, dict) else ()):
        lowered = name.lower()
        grid = any(t in lowered for t in rules.STATE_GRID_KEYS)
        if grid and not any(t in lowered for t in rules.SKIP_WIDGETS):
            items += grid_items(shredded(raw if isinstance(raw, str) else json.dumps(raw)))
    return items


def description(state: State | None) -> str | None:
    """The first text long enough to be a description, by place and then by order of the keys."""
    facts = (
        ((item.first, -item.number, rank), text)
        for item in (state.objects if state is not None else ())
        if item.number in state.level
        for rank, key in enumerate(rules.DESCRIPTION_KEYS)
        if isinstance(item.get(key), str)
        and len(text := item[key].strip()) >= rules.LEAST_DESCRIPTION
    )
    found = min(facts, default=None)
    return found[1][: rules.LONGEST_TEXT] if found is not None else None


def _column(item: dict, keys: tuple[str, ...]) -> object:
    """The first of the keys that holds something; without any, what the last one holds."""
    return next((item[k] for k in keys if item.get(k)), item.get(keys[-1]))


def _object_spec(item: dict) -> tuple[str, str] | None:
    """An object that is a specification by itself."""
    label, value = (_column(item, keys) for keys in rules.SPEC_OBJECT)
    text = "" if value is None else str(value).strip()
    if not isinstance(label, str) or not text or label.lower() in rules.NOT_SPECS:
        return None
    return label.strip(), text


def _line_spec(line: dict) -> tuple[str, str] | None:
    """A line of a list of specifications."""
    label, value = (_column(line, keys) for keys in rules.SPEC_LINE)
    return (str(label).strip(), str(value).strip()) if label and value else None


def specifications(state: State | None) -> dict[str, str]:
    """Labels and values stated anywhere in a state; later ones replace earlier ones."""
    rows = []
    for item in state.in_order() if state is not None else ():
        rows.append(_object_spec(item))
        lists = (item[key] for key in rules.SPEC_LISTS if isinstance(item.get(key), list))
        rows += [_line_spec(line) for lines in lists for line in lines if isinstance(line, dict)]
    return dict(filter(None, rows))
