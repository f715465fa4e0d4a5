"""The matching of ``stacks`` over arrays: one pass over the sorted rows of all drawings, many drawings at once, with nothing but numpy within a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from plumbline.operators.arrays import LARGE, MET, before, codes, column, firsts, numbers, ranges, rows_of, slices, values

#: Kinds of rows: what comes in, what goes out.
TAG, HEADER, BAND = 0, 1, 2
VERDICT, ASSIGNED, EVIDENCE = 0, 1, 2
#: Runs of pairs of readings and stacks that a drawing may have in a task, and as many for each of its rows.
ROOM, ROOM_OF_ROW = 512, 32


def _clusters(g, v, known, tag, tolerance) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((tag, v, known, g))
    gg, vv, nn = g[order], v[order], known[order]
    first, step = firsts(gg), np.zeros(len(order), bool)
    with np.errstate(invalid="ignore"):
        d = vv[1:] - vv[:-1]
    step[1:] = ((d > tolerance) | np.isnan(d)) & nn[1:] & nn[:-1] & ~first[1:]
    number = np.cumsum(step)
    number = number - np.repeat(number[first], np.diff(np.append(np.flatnonzero(first), len(order)))) if len(order) else number
    start = np.flatnonzero(first | step)
    n = np.diff(np.append(start, len(order)))
    kept = np.repeat(n > 1, n)
    return order[kept], number[kept]


def _near_headers(g, x, y, stack, hg, hx, hy, hid, said, reach, n_stacks) -> np.ndarray:
    """What the nearest header of each stack says, -1 without one."""
    order = np.lexsort((hx, hg))
    hg, hx, hy, hid, said = (v[order] for v in (hg, hx, hy, hid, said))
    pad = reach * (1 + 1e-9) + np.abs(x) * 1e-12
    low, high = before(hg, hx, g, x - pad, False), before(hg, hx, g, x + pad, True)
    found = [np.empty((0,))] * 4
    for s, e in slices(high - low, MET):
        owner, at = ranges(low[s:e], high[s:e])
        owner += s
        dx, dy = hx[at] - x[owner], hy[at] - y[owner]
        d = np.sqrt(dx * dx + dy * dy)
        kept = d <= reach
        new = (stack[owner[kept]], d[kept], hid[at[kept]], said[at[kept]])
        found = [np.concatenate([a, b]) for a, b in zip(found, new)]
        first = np.lexsort((found[2], found[1], found[0]))
        found = [v[first][firsts(found[0][first])] for v in found] if len(first) else found
    out = np.full(n_stacks, -1)
    out[found[0].astype(np.int64)] = found[3].astype(np.int64)
    return out


def _lines(g, at, step) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(g, at, number) of lines in order, no two of a drawing closer than ``step``."""
    order = np.lexsort((at, g))
    g, at = g[order], at[order]
    once = firsts(g, at)
    g, at = g[once], at[once]
    first, kept = firsts(g), np.ones(len(g), bool)
    kept[1:] = first[1:] | (at[1:] - at[:-1] > step)
    last, before = 0.0, -2
    for i in np.flatnonzero(~kept).tolist():
        if before != i - 1:
            last = at[i - 1]
        before = i
        if at[i] - last > step:
            kept[i], last = True, at[i]
    g, at = g[kept], at[kept]
    first = np.flatnonzero(firsts(g))
    return g, at, np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g)))) + 1


def _readings(line, colour, low, high, gap, level):
    """Runs of colours (colour, levels) and the bundles over them (line, number, first run, runs), from what the lines meet."""
    middle = (low + high) / 2
    order = np.lexsort((high, low, colour, middle, line))
    line, colour, low, high, middle = (v[order] for v in (line, colour, low, high, middle))
    first = firsts(line)
    start = first.copy()
    start[1:] |= low[1:] - high[:-1] > gap
    same, near = np.zeros(len(line), bool), np.zeros(len(line), bool)
    same[1:] = ~start[1:] & (colour[1:] == colour[:-1]) & (colour[1:] >= 0)
    near[1:] = np.abs(middle[1:] - middle[:-1]) <= level
    runs = np.flatnonzero(~same)
    levels = np.add.reduceat((~(same & near)).astype(np.int64), runs)
    bundles = np.flatnonzero(start[runs])
    of = line[runs[bundles]]
    lead = np.flatnonzero(firsts(of))
    number = np.arange(len(of)) - np.repeat(lead, np.diff(np.append(lead, len(of))))
    return colour[runs], levels, of, number, bundles, np.diff(np.append(bundles, len(runs)))


def _signature(levels, start, n, powers) -> np.ndarray:
    owner, at = ranges(start, start + n)
    with np.errstate(over="ignore"):
        return np.add.reduceat(levels[at].astype(np.uint64) * powers[at - start[owner]], np.cumsum(n) - n) if len(n) else np.empty(0, np.uint64)


def _same(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, rows of b): where all keys are equal, a row of a has the rows of b from low to high."""
    keys = [np.concatenate([x, y]) for x, y in zip(a, b)]
    order = np.lexsort(keys)
    name = np.empty(len(order), np.int64)
    name[order] = np.cumsum(firsts(*[k[order] for k in keys])) if len(order) else 0
    mine, theirs = name[: len(a[0])], name[len(a[0]) :]
    by = np.argsort(theirs, kind="stable")
    return np.searchsorted(theirs[by], mine, "left"), np.searchsorted(theirs[by], mine, "right"), by


def match(rows: pa.Table, g: np.ndarray, schema: pa.Schema, tolerances, keys: list[str]) -> pa.Table:
    """The verdicts, assignments and evidence of whole drawings, g being the rows' drawing: 0, 1, ..."""
    kind = column(rows, "__k").to_numpy()
    part = lambda k: rows.filter(pa.array(kind == k))
    tags, heads, bands = part(TAG), part(HEADER), part(BAND)
    tg, hg, bg = (g[kind == k] for k in (TAG, HEADER, BAND))
    (x, has_x), (y, has_y) = numbers(column(tags, "x")), numbers(column(tags, "y"))
    tag = codes(column(tags, "tag_id"))[0]
    service, services = codes(column(tags, "service"))
    size, sizes = codes(column(tags, "size"))
    sort, sorts = codes(column(tags, "kind"))
    n_drawings = int(g[-1]) + 1
    # Stacks.
    cols, rows_ = _clusters(tg, x, has_x, tag, tolerances.axis), _clusters(tg, y, has_y, tag, tolerances.axis)
    upright = np.zeros(n_drawings, bool)
    upright[tg[cols[0]]] = True
    flat = ~upright[tg[rows_[0]]]
    t, number = np.concatenate([cols[0], rows_[0][flat]]), np.concatenate([cols[1], rows_[1][flat]])
    order = np.lexsort((number, tg[t]))
    t, number = t[order], number[order]
    first = firsts(tg[t], number)
    stack, s_g, s_number = np.cumsum(first) - 1, tg[t][first], number[first]
    n_stacks = len(s_g)
    # Their headers.
    (hx, kx), (hy, ky) = numbers(column(heads, "x")), numbers(column(heads, "y"))
    held, here = kx & ky, (has_x & has_y)[t]
    said = _near_headers(tg[t][here], x[t][here], y[t][here], stack[here], hg[held], hx[held], hy[held], codes(column(heads, "header_id"))[0][held], column(heads, "said").fill_null(-1).to_numpy()[held], tolerances.header, n_stacks)
    # Their runs.
    kept = (service[t] >= 0) & (said[stack] >= 0)
    t, stack = t[kept], stack[kept]
    way = said[stack]
    at, known = np.choose(way, [-y[t], y[t], x[t], -x[t]]), np.where(way < 2, has_y[t], has_x[t])
    order = np.lexsort((tag[t], at, known, stack))
    t, stack = t[order], stack[order]
    fresh = firsts(stack, service[t])
    r_at = np.flatnonzero(fresh)
    r_stack, r_service, r_n = stack[r_at], service[t[r_at]], np.diff(np.append(r_at, len(t)))
    n_runs = np.bincount(r_stack, minlength=n_stacks)
    s_run = np.cumsum(n_runs) - n_runs
    empty = pc.index(sorts, "").as_py() if len(sorts) else -1
    one = np.where(sort[t] < 0, empty, sort[t])
    alike = np.minimum.reduceat(one, r_at) == np.maximum.reduceat(one, r_at) if len(r_at) else np.empty(0, bool)
    r_kind = np.where(alike, sort[t[r_at]], -1)
    order = np.lexsort((r_service, r_stack))
    n_services = np.bincount(r_stack[order][firsts(r_stack[order], r_service[order])], minlength=n_stacks)
    usable = (said >= 0) & (n_runs >= 2) & (n_services >= 2)
    down = np.isin(said, (0, 3))
    powers = np.ones(max(int(n_runs.max(initial=0)), 1), np.uint64)
    with np.errstate(over="ignore"):
        powers[1:] = np.cumprod(np.full(len(powers) - 1, 0x9E3779B97F4A7C15, np.uint64))
    # What the scan lines read along each axis, and which stacks say the same. Where many stacks and readings do, a drawing takes more room than its rows.
    weight, most = np.zeros(n_drawings, np.int64), ROOM + ROOM_OF_ROW * np.bincount(g, minlength=n_drawings)
    colour, colours = codes(column(bands, "colour"))
    sides = {c: numbers(column(bands, c)) for c in ("min_x", "min_y", "max_x", "max_y")}
    full = np.all([s[1] for s in sides.values()], axis=0)
    names, h_stack, h_pairs, h_line, h_bundle, h_from, h_colours, n_read = {}, [], [], [], [], [], [], 0
    for axis, (v, o) in enumerate(("xy", "yx")):
        u = np.flatnonzero(usable & ((said < 2) == (axis == 0)))
        wanted = np.zeros(n_drawings, bool)
        wanted[s_g[u]] = True
        b = np.flatnonzero(full & wanted[bg])
        if not len(b):
            continue
        lo, hi, low, high = (sides[c][0][b] for c in (f"min_{v}", f"max_{v}", f"min_{o}", f"max_{o}"))
        lg, la, ln = _lines(bg[b], (lo + hi) / 2, tolerances.position)
        p, q = before(lg, la, bg[b], lo, False), before(lg, la, bg[b], hi, True)
        change = np.zeros(len(lg) + 1, np.int64)
        np.add.at(change, p, 1)
        np.add.at(change, np.maximum(p, q), -1)
        where, turn = ranges(s_run[u], s_run[u] + n_runs[u])
        ordered = np.where(down[u][where], s_run[u][where] + n_runs[u][where] - 1 - (turn - s_run[u][where]), turn)
        u_levels, u_from = r_n[ordered], np.cumsum(n_runs[u]) - n_runs[u]
        u_key = (_signature(u_levels, u_from, n_runs[u], powers), n_runs[u], s_g[u])
        for s, e in slices(np.cumsum(change)[: len(lg)], MET):
            owner, line = ranges(np.clip(p, s, e), np.clip(q, s, e))
            if not len(line):
                continue
            c, levels, of, bundle, start, n = _readings(line, colour[b][owner], low[owner], high[owner], tolerances.gap, tolerances.level)
            fits = n <= len(powers)
            of, bundle, start, n = of[fits], bundle[fits], start[fits], n[fits]
            first_of, last_of, by = _same((_signature(levels, start, n, powers), n, lg[of]), u_key)
            np.add.at(weight, lg[of], (last_of - first_of) * n)
            read, mine = ranges(first_of, np.where((weight > most)[lg[of]], first_of, last_of))
            mine = by[mine]
            if not len(read):
                continue
            k = n[read]
            hit, place = ranges(np.zeros(len(k), np.int64), k)
            equal = np.logical_and.reduceat(levels[start[read][hit] + place] == u_levels[u_from[mine][hit] + place], np.cumsum(k) - k)
            read, mine, k = read[equal], mine[equal], k[equal]
            hit, place = ranges(np.zeros(len(k), np.int64), k)
            back = down[u[mine]][hit]
            told = c[start[read][hit] + np.where(back, k[hit] - 1 - place, place)]
            says = r_service[s_run[u[mine]][hit] + place]
            order = np.lexsort((says, told, hit))
            pairs, cut = np.stack([told[order], says[order]], axis=1), np.append(0, np.cumsum(k)).tolist()
            h_pairs.append(np.fromiter((names.setdefault(pairs[i:j].tobytes(), len(names)) for i, j in zip(cut, cut[1:])), np.int64, len(k)))
            h_stack.append(u[mine])
            h_line.append(ln[of[read]])
            h_bundle.append(bundle[read])
            h_from.append(np.cumsum(k) - k + n_read)
            h_colours.append(told)
            n_read += len(told)
    gathered = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
    hs, hp, hl, hb, hf, hc = map(gathered, (h_stack, h_pairs, h_line, h_bundle, h_from, h_colours))
    order = np.lexsort((hb, hl, hp, hs))
    hs, hp, hl, hf = (a[order] for a in (hs, hp, hl, hf))
    once = firsts(hs, hp, hl)
    hs, hp, hl, hf = (a[once] for a in (hs, hp, hl, hf))
    lead = firsts(hs, hp)
    island = lead.copy()
    island[1:] |= hl[1:] - hl[:-1] > 1
    i_at, f_at = np.flatnonzero(island), np.flatnonzero(lead)
    stable = np.maximum.reduceat(np.diff(np.append(i_at, len(hs))), np.flatnonzero(lead[i_at])) >= tolerances.stable if len(hs) else np.empty(0, bool)
    n_stable = np.full(n_stacks, -1)
    n_stable[hs] = 0
    np.add.at(n_stable, hs[f_at[stable]], 1)
    # A stack with one stable assignment has the colours of its first line; a drawing whose stacks contradict each other abstains.
    best = f_at[stable]
    best = best[n_stable[hs[best]] == 1]
    ws, wk = hs[best], n_runs[hs[best]]
    owner, place = ranges(np.zeros(len(ws), np.int64), wk)
    w_colour, w_run = hc[hf[best][owner] + place], s_run[ws][owner] + place
    w_g, w_stack = s_g[ws][owner], ws[owner]
    order = np.lexsort((r_service[w_run], w_colour, w_g))
    og, oc, os = w_g[order], w_colour[order], r_service[w_run][order]
    clash = np.zeros(n_drawings, bool)
    if len(og) > 1:
        clash[og[1:][(og[1:] == og[:-1]) & (oc[1:] == oc[:-1]) & (os[1:] != os[:-1])]] = True
    kept = ~clash[w_g]
    w_colour, w_run, w_g, w_stack = w_colour[kept], w_run[kept], w_g[kept], w_stack[kept]
    order = np.lexsort((w_run, w_stack, w_colour, w_g))
    order = order[firsts(w_g[order], w_colour[order])]
    a_g, a_colour, a_run = w_g[order], w_colour[order], w_run[order]
    order = np.lexsort((r_service[w_run], w_stack))
    order = order[firsts(w_stack[order], r_service[w_run][order])]
    e_stack, e_service = w_stack[order], r_service[w_run][order]
    verdict = np.select(
        [said < 0, n_runs == 0, ~usable, n_stable < 0, n_stable == 0, n_stable > 1, clash[s_g]],
        ["no_header", "no_tags", "degenerate", "no_match", "unstable", "ambiguous", "conflict"], "matched",
    ) if n_stacks else np.empty(0, str)
    # The three results as rows.
    heavy = weight > most
    lead = rows.take(pa.array(np.flatnonzero(firsts(g)))).select(keys)
    taken, listed = ranges(r_at[a_run], r_at[a_run] + r_n[a_run])
    offsets = pa.array(np.append(0, np.cumsum(np.bincount(taken, minlength=len(a_run)))), pa.int32())
    made = [
        (s_g, {"__o": np.full(n_stacks, VERDICT), "stack": s_number, "verdict": pa.array(verdict.tolist(), pa.string())}),
        (a_g, {"__o": np.full(len(a_g), ASSIGNED), "colour": values(a_colour, colours), "service": values(r_service[a_run], services),
               "sizes": pa.ListArray.from_arrays(offsets, values(size[t[listed]], sizes)), "kind": values(r_kind[a_run], sorts)}),
        (s_g[e_stack], {"__o": np.full(len(e_stack), EVIDENCE), "stack": s_number[e_stack], "service": values(e_service, services)}),
    ]
    if heavy.any():
        light = [(~heavy[drawing], drawing, out) for drawing, out in made]
        made = [(drawing[k], {c: v[k] if isinstance(v, np.ndarray) else v.filter(pa.array(k)) for c, v in out.items()}) for k, drawing, out in light]
        made.append((np.flatnonzero(heavy), {"__o": np.full(int(heavy.sum()), LARGE)}))
    return rows_of(lead, keys, schema, made)


def fields(given: pa.Schema) -> list:
    """The fields of results, by those of the rows."""
    t = lambda c: given.field(c).type
    return [("stack", pa.int64()), ("verdict", pa.string()), ("colour", t("colour")), ("service", t("service")), ("sizes", pa.list_(t("size"))), ("kind", t("kind"))]
