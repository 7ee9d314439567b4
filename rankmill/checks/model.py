"""A small tree ensemble for the check of tree scoring."""

from __future__ import annotations

FEATURES = ("viewJob_total", "saveJob_total", "applyJob_total", "web_total")


def _leaf(number: int, value: float) -> dict:
    return {"nodeid": number, "leaf": value}


def _split(number: int, name: str, below: float, yes: dict, no: dict, missing: str = "yes") -> dict:
    return {
        "nodeid": number,
        "split": name,
        "split_condition": below,
        "yes": yes["nodeid"],
        "no": no["nodeid"],
        "missing": (yes if missing == "yes" else no)["nodeid"],
        "children": [yes, no],
    }


TREES = (
    _split(
        0,
        "viewJob_total",
        1.0,
        _split(1, "saveJob_total", 1.0, _leaf(3, -0.25), _leaf(4, 0.125), "no"),
        _split(2, "applyJob_total", 1.0, _leaf(5, 0.5), _split(6, "web_total", 2.0, _leaf(7, 0.75), _leaf(8, 1.5))),
    ),
    _split(0, "web_total", 1.0, _leaf(1, 0.0625), _leaf(2, -0.5), "no"),
    _leaf(0, 0.03125),
)
BASE = 0.5
