"""Tag stacks against a loop over random drawings, and each reason to abstain."""

import random
from collections import Counter
from itertools import groupby

from plumbline.operators import stacks

TAGS = "rev string, tag_id int, x double, y double, service string, size string, kind string"
HEADERS = "rev string, header_id int, text string, x double, y double"
BANDS = "rev string, colour string, ring array<struct<x:double,y:double>>"
TOL = stacks.Tolerances()


def rle(values):
    return [(k, len(list(g))) for k, g in groupby(values)]


def loop(tags, headers, bands):
    """({stack: verdict}, {colour: (service, sizes)}, {(stack, service)}) of one drawing."""
    clusters = []
    for axis in (1, 2):
        groups, rows = [], sorted(tags, key=lambda t: (t[axis], t[0]))
        for t in rows:
            if groups and t[axis] - groups[-1][-1][axis] <= TOL.axis:
                groups[-1].append(t)
            else:
                groups.append([t])
        clusters = [(k, g) for k, g in enumerate(groups) if len(g) > 1]
        if clusters:
            break
    lines = {}
    for axis in (0, 1):
        mids, kept = sorted({(b[1][axis] + b[1][axis + 2]) / 2 for b in bands}), []
        for m in mids:
            if not kept or m - kept[-1] > TOL.position:
                kept.append(m)
        lines[axis] = kept
    verdicts, won = {}, []
    for k, cluster in clusters:
        near = min((((h[1] - t[1]) ** 2 + (h[2] - t[2]) ** 2) ** 0.5, h[0], h[3]) for h in headers for t in cluster) if headers else (9, 0, "")
        said = [p for p in stacks.ORIENTATIONS if p in " ".join(near[2].upper().split())]
        if near[0] > TOL.header or len(said) != 1:
            verdicts[k] = "no_header"
            continue
        turn = {"TOP TO BOTTOM": lambda t: -t[2], "BOTTOM TO TOP": lambda t: t[2], "LEFT TO RIGHT": lambda t: t[1], "RIGHT TO LEFT": lambda t: -t[1]}[said[0]]
        entries = [t for t in sorted(cluster, key=lambda t: (turn(t), t[0])) if t[3]]
        runs = rle([t[3] for t in entries])
        if not entries:
            verdicts[k] = "no_tags"
            continue
        if len(runs) < 2 or len({s for s, _ in runs}) < 2:
            verdicts[k] = "degenerate"
            continue
        axis, down = (0 if said[0][:3] in ("TOP", "BOT") else 1), said[0] in ("TOP TO BOTTOM", "RIGHT TO LEFT")
        hits, first = {}, {}
        for i, at in enumerate(lines[axis]):
            o = 1 - axis
            crossed = sorted(((b[1][o] + b[1][o + 2]) / 2, b[0], b[1][o], b[1][o + 2]) for b in bands if b[1][axis] <= at <= b[1][axis + 2])
            bundles = []
            for c in crossed:
                if not bundles or c[2] - bundles[-1][-1][3] > TOL.gap:
                    bundles.append([])
                bundles[-1].append(c)
            for bundle in bundles:
                bundle = bundle[::-1] if down else bundle
                levels = [bundle[0][1]]
                for p, c in zip(bundle, bundle[1:]):
                    if c[1] != p[1] or abs(c[0] - p[0]) > TOL.level:
                        levels.append(c[1])
                colours = rle(levels)
                if [n for _, n in colours] == [n for _, n in runs]:
                    key = tuple(sorted((c, s) for (c, _), (s, _) in zip(colours, runs)))
                    hits.setdefault(key, set()).add(i)
                    first.setdefault(key, [c for c, _ in colours])
        stable = [m for m, at in hits.items() if any(i + 1 in at for i in at)]
        verdicts[k] = "no_match" if not hits else "unstable" if not stable else "ambiguous" if len(stable) > 1 else "matched"
        if len(stable) == 1:
            won.append((k, stable[0], first[stable[0]], runs, entries))
    told = {}
    for _, pairs, *_ in won:
        for c, s in pairs:
            told.setdefault(c, set()).add(s)
    if any(len(s) > 1 for s in told.values()):
        return {k: "conflict" if v == "matched" else v for k, v in verdicts.items()}, {}, set()
    sizes = {}
    for _, _, colours, runs, entries in won:
        at = 0
        for c, (s, n) in zip(colours, runs):
            sizes.setdefault(c, (s, tuple(e[4] for e in entries[at : at + n])))
            at += n
    return verdicts, sizes, {(k, s) for k, _, _, runs, _ in won for s, _ in runs}


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def test_random_drawings_equal_a_loop(spark):
    r = random.Random(17)
    tags, headers, bands, want = [], [], [], {}
    for d in range(240):
        rev, mine, heads, boxes = str(d), [], [], []
        upright = r.random() < 0.5
        services = [r.choice(("SA", "EA", "RA")) for _ in range(r.randrange(2, 5))]
        for _ in range(r.choice((1, 1, 2))):
            off = r.choice((0.0, 30.0))
            for i, s in enumerate(services):
                place = 0.5 * i
                mine.append((len(mine), off + r.choice((0, 0.05)) if upright else place, place if upright else off + r.choice((0, 0.05)), s if r.random() < 0.97 else None, str(50 * i)))
            phrase = r.choice(stacks.ORIENTATIONS[:2] if upright else stacks.ORIENTATIONS[2:]) if r.random() < 0.9 else r.choice(("TOP TO BOTTOM LEFT TO RIGHT", "note"))
            heads.append((len(heads), off if upright else -0.3, -0.3 if upright else off, f"from {phrase.lower()}:"))
        palette = {s: f"c{i}" for i, s in enumerate(("SA", "EA", "RA"))} if r.random() < 0.8 else {s: r.choice(("c0", "c1")) for s in ("SA", "EA", "RA")}
        for b in range(r.choice((1, 1, 2))):
            start = 12.0 * b
            order = services if r.random() < 0.7 else services[::-1]
            if r.random() < 0.2:
                order = order[:-1]
            spread = r.choice((0.0, 0.5))
            for i, s in enumerate(order):
                low, long = start + 0.3 * i, 10.0 + spread * i
                boxes.append((palette[s], (0.0, low, long, low + 0.2) if upright else (low, 0.0, low + 0.2, long)))
        tags += [(rev, *t, "round") for t in mine]
        headers += [(rev, h[0], h[3], h[1], h[2]) for h in heads]
        bands += [(rev, c, box(*b)) for c, b in boxes]
        want[rev] = loop(mine, heads, boxes)
    got = stacks.match_stacks(spark.createDataFrame(tags, TAGS), spark.createDataFrame(headers, HEADERS), spark.createDataFrame(bands, BANDS), 4.0, ["rev"])
    verdicts = {(x["rev"], x["stack"]): x["verdict"] for x in got.verdicts.collect()}
    assert verdicts == {(rev, k): v for rev, (found, *_) in want.items() for k, v in found.items()}
    assert {"matched", "no_header", "degenerate", "no_match", "unstable", "ambiguous", "conflict"} <= set(verdicts.values()), Counter(verdicts.values())
    assert {(x["rev"], x["colour"]): (x["service"], tuple(x["sizes"])) for x in got.assigned.collect()} == {(rev, c): v for rev, (_, sizes, _) in want.items() for c, v in sizes.items()}
    assert {(x["rev"], x["stack"], x["service"]) for x in got.evidence.collect()} == {(rev, k, s) for rev, (*_, said) in want.items() for k, s in said}


def test_empty_drawings(spark):
    none = [spark.createDataFrame([], s) for s in (TAGS, HEADERS, BANDS)]
    got = stacks.match_stacks(*none, 4.0, ["rev"])
    assert [x.count() for x in got] == [0, 0, 0]
