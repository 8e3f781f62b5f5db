from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from tessella.operators.units import QUANTITIES, STATED_STANDS, STATES, common_amounts, same_amount_pairs, viterbi

CELLS = "id string, table_id string, row_index bigint, column_index bigint, raw_value string, unit string"


def build(frame, columns):
    """columns: (table, header, inferred unit, caption, {label: text})."""
    cells, cols, tabs = [], [], []
    for n, (t, header, unit, caption, values) in enumerate(columns):
        tabs.append((t, caption, dt.datetime(2025, 1, 1) + dt.timedelta(days=n)))
        cols += [(t, 0, "Specimen", None), (t, 1, header, unit)]
        cells += [(f"{t}-h0", t, 0, 0, "Specimen", None), (f"{t}-h1", t, 0, 1, header, None)]
        for r, (label, text) in enumerate(values.items(), 1):
            cells += [(f"{t}-{r}l", t, r, 0, label, None), (f"{t}-{label}", t, r, 1, text, None)]
    return (
        frame(cells + cells[-2:], CELLS, "device", "amount", "label"),
        frame(cols, "table_id string, column_index bigint, raw_header string, inferred_unit string"),
        frame(tabs, "id string, caption string, created_at timestamp"),
        frame([("mass", "kg"), ("temperature", "K"), ("length", "m"), ("volume", "L"), ("pressure", "Pa")], "quantity string, common_unit string"),
    )


def test_where_the_unit_stands_and_how_numbers_look(frame):
    tables = build(
        frame,
        [
            ("a", "Mass", None, "T; masses in g", {"x": "1.5 kg", "y": "250", "z": "n/a", "w": "2 apples", "v": "9 lb 8 oz"}),
            ("b", "Dry mass (mg)", "kg", None, {"x": "1,500,000", "y": "2.5 × 10^5 ± 3", "z": None}),
            ("c", "Net mass", "g", None, {"x": "1499,5", "y": "250,25", "z": "1,234"}),
            ("d", "Temp, degF", None, None, {"x": "212"}),
            ("e", "Count", None, None, {"x": "7"}),
        ],
    )
    got = {r.cell_id: (round(r.amount, 6), r.unit, r.source) for r in common_amounts(*tables).collect()}
    assert got == {
        "a-x": (1.5, "kg", "cell"),
        "a-y": (0.25, "g", "caption"),
        "a-v": (round(9 * 0.45359237 + 8 * 0.028349523125, 6), "lb+oz", "cell"),
        "b-x": (1.5, "mg", "header"),
        "b-y": (0.25, "mg", "header"),
        "c-x": (1.4995, "g", "column"),
        "c-y": (0.25025, "g", "column"),
        "c-z": (0.001234, "g", "column"),
        "d-x": (373.15, "°F", "header"),
    }


def test_pairs(frame):
    tables = build(frame, [("a", "Mass", "kg", None, {"x": "1.5", "y": "2"}), ("b", "Mass", "g", None, {"x": "1503", "y": "2100"}), ("c", "Mass", "kgs", None, {"x": "1.5"}), ("d", "Volume", "L", None, {"x": "1.5"}), ("e", "Volume", "cc", None, {"x": "1500"})])
    got = {(r.cell_a, r.cell_b) for r in same_amount_pairs(common_amounts(*tables)).collect()}
    assert got == {("a-x", "b-x"), ("b-x", "c-x"), ("d-x", "e-x")}


def test_the_model_supplies_a_unit_that_nothing_states(frame):
    """A value a thousand times as large beside a steady level is in the unit a thousand times as small."""
    tables = build(frame, [("a", "Mass", "kg", None, {"x": "1.50"}), ("b", "Mass", None, None, {"x": "1502"}), ("c", "Mass", "kg", None, {"x": "1.51"}), ("d", "Mass", None, None, {"x": "1.49"})])
    got = {r.cell_id: (r.unit, r.source) for r in common_amounts(*tables).collect()}
    assert got["b-x"] == ("g", "decoded") and got["d-x"] == ("kg", "decoded")
    assert {r.cell_id: r.unit for r in common_amounts(*tables, stretch=1, overlap=3).collect()} == {k: u for k, (u, _) in got.items()}


def test_a_level_outweighs_a_wrong_column_but_not_the_cell_itself(frame):
    """Nine tables agree on a level; the tenth says grams in its column, or in the cell, for what are kilograms."""
    steady = [(f"t{i}", "Mass", "kg", None, {"x": f"1.5{i}", "y": f"7.0{i}"}) for i in range(9)]
    wrong = steady[:5] + [("w", "Mass", "g", None, {"x": "1.52", "y": "7.02 g"})] + steady[5:]
    got = {r.cell_id: (r.unit, r.stated_unit, r.source) for r in common_amounts(*build(frame, wrong)).collect()}
    assert got["w-x"] == ("kg", "g", "overruled") and got["w-y"] == ("g", "g", "cell") and got["t3-x"] == ("kg", "kg", "column")
    stands = {r.cell_id: r.unit for r in common_amounts(*build(frame, wrong), trust=STATED_STANDS).collect()}
    assert stands["w-x"] == "g"


def test_decoded_units_make_pairs(frame):
    tables = build(frame, [("a", "Mass", "kg", None, {"x": "1.50"}), ("b", "Mass", None, None, {"x": "1502"}), ("c", "Mass", "kg", None, {"x": "1.501"})])
    got = {(r.cell_a, r.cell_b) for r in same_amount_pairs(common_amounts(*tables, trust=STATED_STANDS)).collect()}
    assert got == {("a-x", "b-x"), ("b-x", "c-x")}


def test_units_that_are_hidden_come_back(frame):
    """A steady level, read in units that a device changes now and then, three in ten of them not stated."""
    rng = np.random.default_rng(3)
    names = [("kg", 1.0), ("g", 1e-3), ("mg", 1e-6), ("lb", 0.45359237), ("oz", 0.028349523125)]
    columns, truth, now = [], {}, 0
    level = {f"d{i}": rng.lognormal(0, 3) for i in range(12)}
    for n in range(60):
        now = int(rng.integers(len(names))) if rng.random() < 0.3 else now
        name, size = names[now]
        hidden = rng.random() < 0.3
        values = {}
        for label in level:
            level[label] *= np.exp(rng.normal(0, 0.01))
            values[label] = repr(float(level[label] / size))
            if hidden:
                truth[f"t{n:02d}-{label}"] = name
        columns.append((f"t{n:02d}", "Mass", None if hidden else name, None, values))
    got = {r.cell_id: r.unit for r in common_amounts(*build(frame, columns)).where("source = 'decoded'").collect()}
    assert got.keys() == truth.keys() and np.mean([got[c] == u for c, u in truth.items()]) >= 0.95


def test_stretches_give_the_path_of_the_whole(frame):
    rng = np.random.default_rng(5)
    columns = [(f"t{n:03d}", "Mass", [None, "kg", "g"][int(rng.integers(3))], None, {"x": repr(float(rng.choice([2.0, 2000.0]) * np.exp(rng.normal(0, 0.01))))}) for n in range(80)]
    tables = build(frame, columns)
    whole = {r.cell_id: r.unit for r in common_amounts(*tables).collect()}
    cut = [(r.cell_id, r.unit) for r in common_amounts(*tables, stretch=20, overlap=10).collect()]
    assert len(cut) == len(whole) == 80 and dict(cut) == whole


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(0)
    q = QUANTITIES.index("duration")
    n_states = 5
    for _ in range(20):
        values, stated = rng.lognormal(3, 2, 4), np.where(rng.random(4) < 0.4, rng.integers(0, n_states, 4), -1)
        path = viterbi(np.zeros(4, dtype=int), np.full(4, q), values, stated)

        def score(p, values=values, stated=stated):
            total = 0.0
            for t in range(4):
                total += (0.0 if p[t] == stated[t] else -60.0) if stated[t] >= 0 else -np.log(n_states)
                if t:
                    a, b = (np.log(values[i] * STATES["duration"][p[i]][1]) for i in (t - 1, t))
                    total += (np.log(0.6) if p[t] == p[t - 1] else np.log(0.4 / 8)) - min(8.0, abs(a - b) / 0.05)
            return total

        best = max(score(p) for p in np.ndindex(*[n_states] * 4))
        assert score(path) == pytest.approx(best)


def test_empty_tables(frame):
    cells, cols, tabs, goals = build(frame, [("a", "Mass", "kg", None, {"x": "1"})])
    none = common_amounts(cells.limit(0), cols.limit(0), tabs.limit(0), goals.limit(0))
    assert none.count() == 0 and same_amount_pairs(none).count() == 0
