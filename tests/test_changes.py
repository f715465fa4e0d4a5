"""Changesets against a loop that replays their operations one by one."""

import random

from plumbline.operators import changes

OPS = "set_id int, sequence_index int, operation_type string, entity string, value string, property string"
ENTITIES = "entity string, layer string, properties map<string,string>"


def loop(entities, operations):
    """(results of the set, or None where an operation fails; the errors of all operations)."""
    live = {}
    for name, layer, properties in entities:
        live.setdefault(name, []).append({"version": 0, "layer": layer, "properties": dict(properties or {}), "effects": set(), "notes": [], "flags": [], "touched": False})
    versions, done, failed = {}, [], False
    for kind, name, value, path in operations:
        here = live.get(name, [])
        if kind not in changes.APPLIED or name is None or (len(here) != 1 if kind != "add_entity" else bool(here)):
            failed = True
            break
        if kind == "add_entity":
            versions[name] = versions.get(name, 0) + 1
            live[name] = [{"version": versions[name], "layer": value, "properties": {}, "effects": {"added"}, "notes": [], "flags": [], "touched": True}]
            continue
        e = here[0]
        e["touched"] = True
        if kind == "remove_entity":
            e["effects"] = {"removed"}
            done.append((name, e))
            live[name] = []
        elif kind == "change_layer":
            if not (value or "").strip():
                failed = True
                break
            aliases = {k: value if k in changes.LAYER_KEYS else v for k, v in e["properties"].items()}
            if (value, aliases) != (e["layer"], e["properties"]):
                e["effects"].add("changed")
            e["layer"], e["properties"] = value, aliases
        elif kind == "update_property":
            key = (path or "").strip().removeprefix("properties.")
            if key not in changes.PROPERTIES or value is None:
                failed = True
                break
            if e["properties"].get(key) != value or key not in e["properties"]:
                e["effects"].add("metadata_only")
            e["properties"][key] = value
        elif kind == "annotate_entity":
            if not (value or "").strip():
                failed = True
                break
            e["effects"].add("metadata_only")
            e["notes"].append(value)
        else:
            e["effects"].add("metadata_only")
            e["flags"].append(value)
    if failed:
        return None
    done += [(name, e) for name, rows in live.items() for e in rows if e["touched"]]
    order = ("removed", "added", "changed", "metadata_only")
    return sorted((n, e["version"], e["layer"], tuple(sorted(e["properties"].items())), tuple(e["notes"]), tuple(x for x in e["flags"] if x is not None), next((x for x in order if x in e["effects"]), "unchanged")) for n, e in done)


def test_random_sets_equal_a_plain_loop(spark):
    r = random.Random(11)
    entities = [(f"e{i}", r.choice("AB"), r.choice(({}, {"label": "x", "layer": "A"}, {"layer_ref": "B", "new_layer": "A", "k": "v"}, None))) for i in range(4)] + [("twice", "A", None)] * 2
    kinds = ["change_layer"] * 5 + ["update_property"] * 4 + ["annotate_entity", "flag_for_review", "remove_entity", "remove_entity", "add_entity", "add_entity"]
    sets = {}
    for s in range(400):
        ops = []
        for _ in range(r.randrange(1, 9)):
            kind = r.choice(kinds) if r.random() < 0.99 else r.choice(("explode", "replace_block"))
            name = r.choice(("e0", "e1", "e2", "n1") if r.random() < 0.97 else ("twice", None, "zz"))
            value = r.choice("AB") if r.random() < 0.98 else r.choice((None, " "))
            ops.append((kind, name, value, r.choice(("label", "properties.mark", " notes ")) if r.random() < 0.98 else "geometry"))
        sets[s] = ops
    sets[1000] = [("remove_entity", "e1", None, None), ("change_layer", "e1", "B", None)]
    sets[1001] = [("remove_entity", "e2", None, None), ("add_entity", "e2", "C", None), ("change_layer", "e2", "B", None)]
    rows = [(s, i, *op) for s, ops in sets.items() for i, op in enumerate(ops)]
    r.shuffle(rows)
    e, o = spark.createDataFrame(entities, ENTITIES), spark.createDataFrame([(s, i, k, n, v, p) for s, i, k, n, v, p in rows], OPS)
    got = {}
    for x in changes.apply_sets(e, o).collect():
        row = (x["entity"], x["version"], x["layer"], tuple(sorted(x["properties"].items())), tuple(x["annotations"]), tuple(v for v in x["flags"] if v is not None), x["effect"])
        got.setdefault(x["set_id"], []).append(row)
    want = {s: loop(entities, ops) for s, ops in sets.items()}
    assert 50 < sum(w is not None for w in want.values()) < 390 and want[1000] is None
    assert [(n, v, effect) for n, v, *_, effect in want[1001]] == [("e2", 0, "removed"), ("e2", 1, "added")]
    assert {s: sorted(v) for s, v in got.items()} == {s: w for s, w in want.items() if w is not None}
    nothing = spark.createDataFrame([], "layer string"), spark.createDataFrame([("A",), ("B",)], "block string")
    refused = {x["set_id"] for x in changes.findings(o, e, *nothing).where("severity = 'error' or code = 'review_only'").collect()}
    assert refused == {s for s, w in want.items() if w is None}
