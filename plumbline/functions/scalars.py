"""Column functions: money, texts, hashes, geometry, colours, parsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres in one unit.
METRES = {
    "mm": 0.001, "cm": 0.01, "dm": 0.1, "m": 1.0, "km": 1000.0, "in": 0.0254, "ft": 0.3048, "yd": 0.9144, "mi": 1609.344,
}


def money(x: Column) -> Column:
    """Two places, half up (away from zero)."""
    return F.round(x.cast("decimal(38,12)"), 2)


def catalog_value(x: Column) -> Column:
    return F.round(x.cast("decimal(38,12)"), 6)


def decimal_text(x: Column) -> Column:
    """Shortest text of a decimal: no trailing zeros, no negative zero."""
    t = x.cast("string")
    t = F.when(t.contains("."), F.regexp_replace(F.regexp_replace(t, "0+$", ""), "[.]$", "")).otherwise(t)
    return F.when(t == "-0", F.lit("0")).otherwise(t)


def spreadsheet_safe(x: Column) -> Column:
    """A quote before texts that a spreadsheet would read as a formula."""
    return F.when(x.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), x)).otherwise(x)


def prefixed_sha256(x: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(x, 256))


def valid_hash(x: Column) -> Column:
    """A 64-digit hex hash in lower case, else null."""
    t = F.lower(F.trim(x))
    return F.when(t.rlike("^[0-9a-f]{64}$"), t)


def derived_uuid(namespace: str, key: Column) -> Column:
    """Name-based UUID of version 5: the SHA-1 of the namespace UUID's 16 bytes and the key, with version and variant bits."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(key, "UTF-8")))
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
    fixed = F.lower(F.hex(nibble.bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), fixed, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12)
    )


def canonical_json(text: Column) -> Column:
    """JSON text with sorted keys and no spaces; null for text that isn't JSON. Numbers that aren't finite become the texts ``nan``,
    ``infinity`` and ``-infinity``."""
    # Quotes outside of escapes alternate between strings and what is around them.
    hidden = F.replace(F.replace(text, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))

    def quoted(part: Column) -> Column:
        for said, token in ((r"-Infinity\b", "-infinity"), (r"\bInfinity\b", "infinity"), (r"\bNaN\b", "nan")):
            part = F.regexp_replace(part, said, f'"{token}"')
        return part

    parts = F.transform(F.split(hidden, '"', -1), lambda x, i: F.when(i % 2 == 0, quoted(x)).otherwise(x))
    shown = F.replace(F.replace(F.array_join(parts, '"'), F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))
    return F.to_json(F.try_parse_json(F.when(text.rlike("NaN|Infinity"), shown).otherwise(text)))


def normalised_text(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"\\L", ""), r"\s+", " "))


def humanised(x: Column) -> Column:
    """A family name as words: separators become spaces, runs collapse."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[_\-#]+", " "), r"\s+", " "))


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))


def point_segment_distance(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance of a point to a segment; a segment without length is its point."""
    dx, dy = x1 - x0, y1 - y0
    size = dx * dx + dy * dy
    t = F.when(size == 0, F.lit(0.0)).otherwise(((px - x0) * dx + (py - y0) * dy) / size)
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return distance(px, py, x0 + t * dx, y0 + t * dy)


def box_distance_squared(px: Column, py: Column, box: Column) -> Column:
    dx = F.greatest(box["min_x"] - px, F.lit(0.0), px - box["max_x"])
    dy = F.greatest(box["min_y"] - py, F.lit(0.0), py - box["max_y"])
    return dx * dx + dy * dy


def ring_area(ring: Column) -> Column:
    """Signed shoelace area of an array of (x, y) structs, closed or not."""
    following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    terms = F.zip_with(ring, following, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.aggregate(terms, F.lit(0.0), lambda s, v: s + v) / 2


def path_length(points: Column) -> Column:
    """Length of an open polyline."""
    later = F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0)))
    early = F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0)))
    parts = F.zip_with(early, later, lambda a, b: distance(a["x"], a["y"], b["x"], b["y"]))
    return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)


def is_closed(points: Column, flag: Column | None = None) -> Column:
    """The flag, or first and last point alike with at least three points."""
    same = (F.size(points) >= 3) & (F.element_at(points, 1) == F.element_at(points, -1))
    return same if flag is None else F.coalesce(flag, F.lit(False)) | same


def inside_ring(px: Column, py: Column, ring: Column) -> Column:
    """Point in polygon, the boundary included: on an edge, or an odd number of crossings."""
    following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    edges = F.zip_with(ring, following, lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def on_edge(e: Column) -> Column:
        a, b = e["a"], e["b"]
        cross = (b["x"] - a["x"]) * (py - a["y"]) - (b["y"] - a["y"]) * (px - a["x"])
        between = (px >= F.least(a["x"], b["x"])) & (px <= F.greatest(a["x"], b["x"])) & (py >= F.least(a["y"], b["y"])) & (py <= F.greatest(a["y"], b["y"]))
        return (cross == 0) & between

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        x = (b["x"] - a["x"]) * (py - a["y"]) / (b["y"] - a["y"]) + a["x"]
        return ((a["y"] > py) != (b["y"] > py)) & (px < x)

    return F.exists(edges, on_edge) | (F.size(F.filter(edges, crosses)) % 2 == 1)


def grid_cell(x: Column, size: float) -> Column:
    """Cell number by rounding half to even."""
    return F.bround(x / F.lit(size)).cast("long")


def colour_channels(rgb: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue of six hex digits, or of the last six of eight, with or without #."""
    h = F.regexp_extract(rgb, "([0-9A-Fa-f]{6})$", 1)
    return tuple(F.conv(F.substring(h, i, 2), 16, 10).cast("int") for i in (1, 3, 5))


def achromatic(rgb: Column, spread: int = 30) -> Column:
    """Channels closer than spread; an index colour counts as chromatic."""
    r, g, b = colour_channels(rgb)
    return F.when(rgb.startswith("idx:"), F.lit(False)).otherwise(F.greatest(r, g, b) - F.least(r, g, b) < spread)


def hue(rgb: Column) -> Column:
    """Hue in degrees, null for grey."""
    r, g, b = colour_channels(rgb)
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = (top - low).cast("double")
    raw = F.when(top == r, (g - b) / span).when(top == g, (b - r) / span + 2).otherwise((r - g) / span + 4)
    return F.when(span > 0, F.pmod(raw * 60, F.lit(360.0)))


def hue_distance(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.least(d, 360 - d)


def colour_key(rgb: Column, index: Column) -> Column:
    return F.coalesce(F.lower(rgb), F.concat(F.lit("idx:"), index.cast("string")))


def fraction_band(x: Column, elevated: float = 0.5, critical: float = 0.9) -> Column:
    return F.when(x.isNull(), F.lit(None)).when(x >= critical, "critical").when(x >= elevated, "elevated").otherwise("ok")


def to_metres(value: Column, unit: Column) -> Column:
    """Length in metres; null for a unit that isn't known."""
    table = F.create_map(*[F.lit(x) for pair in METRES.items() for x in pair])
    return value * table[F.lower(F.trim(unit))]


def first_rule(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """The name of the first condition that holds."""
    out = F.when(F.lit(False), F.lit(default))
    for condition, name in rules:
        out = out.when(condition, F.lit(name))
    return out.otherwise(F.lit(default))


#: Words after a size that are units or dimension marks, and words of notes; neither is a service.
UNIT_WORDS = ("MM", "MMX", "CM", "M", "X")
NOTE_WORDS = tuple(
    "ABOVE BELOW AND OR IN ON AT TO FROM WITH THE A OF AS PER NOT WHERE EACH SHALL BE FOR BY THIS THAT ARE IS ALL AN INTO ONTO OVER UNDER".split()
)
#: Service codes of pipe and duct runs where a sheet has no legend.
STANDARD_SERVICES = tuple(
    "SVP SWP VP RWP CDP CPD WP FW SS VE VAC MA OXY AGSS N2O SA RA EA OA DA CHW LTHW MWS CWS HWS CW HW".split()
)
#: How a size and what follows it are written.
_RECT = r"(?i)(\d+)\s*(?:mm)?\s*x\s*(\d+)\s*(?:mm)?\s+(.+)$"
_ROUND_MM, _ROUND_GLYPH, _ROUND_BARE = r"(?i)(\d+)\s*mm\s+([A-Za-z/]+)", "(\\d{2,3})\\s*[∅Ø�?]\\s*([A-Za-z/]+)", r"(\d+)\s+([A-Za-z/]+)"
_NOTE = r"(?i)@|\b(?:tel|fax|www)\b|\.co\.|\.uk|\.com|\d{6}"


def round_tag(text: Column, legend: Sequence[str] = (), strict: bool = False) -> Column:
    """Pipe tag as (service, size_kind, diameter, width, height, raw); null where the text isn't one.

    A size is followed by its service, in upper case: ``300x200 SA`` (whose service may have several words),
    ``100 mm SA``, ``100Ø SA`` or ``100 SA``, in this order. Texts on a header vessel, and sizes followed by a unit or a
    word of a note, aren't tags. ``strict`` refuses contact details too, takes a glyph's service only from the
    legend (from STANDARD_SERVICES without one), and a bare size only beside a diameter mark or a legend's service.
    """
    t = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i)^\\L", ""), r"\s+", " "))
    part = lambda p, i: F.regexp_extract(t, p, i)
    none, no_words = F.lit(None).cast("int"), [*UNIT_WORDS, *NOTE_WORDS]

    def made(s: Column, kind: str, raw: Column, d: Column = none, w: Column = none, h: Column = none) -> Column:
        return F.struct(s.alias("service"), F.lit(kind).alias("size_kind"), d.alias("diameter"), w.alias("width"), h.alias("height"), raw.alias("raw"))

    # The words up to the first unit or note word, or to an ampersand without a word before it; none at the end.
    words = F.split(F.upper(F.trim(part(_RECT, 3))), " ")
    stops = F.transform(words, lambda w, i: w.isin(no_words) | ((w == "&") & ((i == 0) | (F.get(words, i - 1) == "&"))))
    first = F.array_position(stops, True)
    run = F.array_join(F.when(first == 0, words).otherwise(F.slice(words, F.lit(1), F.greatest(first - 1, F.lit(0)).cast("int"))), " ")
    run = F.regexp_replace(run, r"( ?&)+$", "")
    size = lambda p, i: part(p, i).try_cast("int")
    rect = F.when(run != "", made(run, "rect", F.concat(part(_RECT, 1), F.lit("x"), part(_RECT, 2)), none, size(_RECT, 1), size(_RECT, 2)))

    def round_(p: str, allowed: Column) -> Column:
        service = F.upper(part(p, 2))
        return F.when(~service.isin(no_words) & allowed(service), made(service, "round", part(p, 1), size(p, 1)))

    known = lambda s: s.isin(list(legend) or list(STANDARD_SERVICES))
    marked = lambda s: t.rlike("(?i)[∅Ø�]|mm") | (s.isin(list(legend)) if legend else F.lit(False))
    any_ = lambda s: F.lit(True)
    found = (
        F.when(t.rlike(_RECT), rect)
        .when(t.rlike(_ROUND_MM), round_(_ROUND_MM, any_))
        .when(t.rlike(_ROUND_GLYPH), round_(_ROUND_GLYPH, known if strict else any_))
        .when(t.rlike(_ROUND_BARE), round_(_ROUND_BARE, marked if strict else any_))
    )
    refused = t.rlike(r"(?i)\bheader\b") | (t.rlike(_NOTE) if strict else F.lit(False))
    return F.when(~refused, found)


#: A room number is a dotted token with a digit; the strict form is led by digits and has three short parts or more.
ROOM_NUMBER, STRICT_ROOM_NUMBER = r"\b[A-Za-z0-9]+(?:\.[A-Za-z0-9]+)+\b", r"\b\d{1,3}(?:\.[A-Za-z0-9]{1,3}){2,}\b"
#: Sizes, counts and routing notes, which no room name has.
_NOT_ROOM_NAMES = r"(?i)Ø|\d+\s*mm|\d+\s*x\s*\d+|^\s*\d+\s*no\.?|\bFROM\s+TOP\b|\bTO\s+BOTTOM\b|\bTO\s+LL\b|\bHEADER\b|\bTB\b"


def room_number(text: Column) -> Column:
    """The first dotted token with a digit."""
    tokens = F.filter(F.regexp_extract_all(text, F.lit(ROOM_NUMBER), F.lit(0)), lambda x: x.rlike("[0-9]"))
    return F.when(F.size(tokens) > 0, tokens[0])


def plausible_room_name(text: Column, longest: int = 40) -> Column:
    """A name with a letter, no sentence or leader end, no size, count or routing note, not over ``longest``, and not capitals in several words."""
    t = F.trim(text)
    capitals = (t == F.upper(t)) & (F.lower(t) != t) & t.rlike("[ -]")
    bad = ~t.rlike(r"\p{L}") | t.rlike(r"[:.]$") | t.startswith("\\L") | t.rlike(_NOT_ROOM_NAMES) | (F.length(t) > longest) | capitals
    return F.coalesce(~bad, F.lit(False))


def genuine_room(number: Column, name: Column, strict: Column | None = None) -> Column:
    """A room with a number or a plausible name; where ``strict`` holds, with a strict number only."""
    loose = F.coalesce(room_number(number).isNotNull(), F.lit(False)) | plausible_room_name(name)
    if strict is None:
        return loose
    return F.when(strict, F.coalesce(number.rlike(STRICT_ROOM_NUMBER), F.lit(False))).otherwise(loose)


def family_type_name(raw: Column) -> Column:
    """A block name as a device type: without its legend stage and its id and what follows; one half where both are alike; null for a placeholder."""
    t = F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.trim(raw), r"(?i)_legend stage\s+\d+\s*$", "")), r"(?s)-\d{5,}.*$", ""))
    halves = F.split(t, " - ", 2)
    left, right = F.trim(halves[0]), F.trim(F.get(halves, F.lit(1)))
    t = F.when((F.size(halves) == 2) & (F.lower(left) == F.lower(right)), left).otherwise(t)
    core = F.lower(F.regexp_replace(t, "[^0-9A-Za-z]", ""))
    return F.when(~core.isin("", "family"), t)


#: Parts of block names that name building fabric, and annotation.
ARCHITECTURE_NAMES = (
    "Room Tag", "Room Name", "Grid", "Mullion", "Door", "Gate", "Window", "Curtain", "Placeholder", "Column", "Louvre", "Hardscape", "_rvt",
    "Top Rail", "Handrail", "Railing", "Basic Wall", "System Panel",
)
ANNOTATION_NAMES = (
    "North Arrow", "Scale Bar", "Detail Marker", "Section Marker", "Elevation Marker", "Revision Cloud", "Title Block", "Titleblock", "Annotation",
)


def instance_kind(layer: Column, block: Column, tag: Column, in_legend_family: Column, in_legend_tags: Column, legend_layer: str = "legend") -> Column:
    """Kind of a placed block, the first that holds: legend exemplar by its layer, device by legend family, architecture,
    annotation, device by legend tag, device by any tag, unknown."""
    b = F.lower(F.coalesce(block, F.lit("")))
    any_of = lambda names: b.rlike("|".join(n.lower() for n in names))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return first_rule(
        [
            (yes(F.lower(layer).contains(legend_layer)), "legend_exemplar"), (yes(in_legend_family) & (b != ""), "device"), (any_of(ARCHITECTURE_NAMES), "architecture"),
            (any_of(ANNOTATION_NAMES), "annotation"), (tag.isNotNull() & yes(in_legend_tags), "device"), (tag.isNotNull(), "device"),
        ],
        "unknown",
    )


def mean_point(points: Column) -> Column:
    """Mean of an array of points; null where it is empty."""
    mean = lambda axis: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[axis]) / F.size(points)
    return F.when(F.size(points) > 0, F.struct(mean("x").alias("x"), mean("y").alias("y")))


def symbol_anchor(centre: Column, vertices: Column, box: Column) -> Column:
    """A symbol's place: its centre, else the mean of its vertices, else the middle of its box."""
    middle = F.struct(((box["min_x"] + box["max_x"]) / 2).alias("x"), ((box["min_y"] + box["max_y"]) / 2).alias("y"))
    return F.coalesce(centre, mean_point(vertices), F.when(box.isNotNull(), middle))


def representative_point(start: Column, end: Column, points: Column) -> Column:
    """A run member's place: the middle of a line, else the mean of a polyline's points."""
    middle = F.struct(((start["x"] + end["x"]) / 2).alias("x"), ((start["y"] + end["y"]) / 2).alias("y"))
    return F.coalesce(F.when(start.isNotNull() & end.isNotNull(), middle), mean_point(points))


def prose_line(text: Column) -> Column:
    """(abbreviation, definition) of ``ABC - words``, else null."""
    p = r"^\s*([A-Z][A-Z0-9/]{0,7})\s*[-–:=]\s*(\S.*?)\s*$"
    return F.when(text.rlike(p), F.struct(F.regexp_extract(text, p, 1).alias("abbreviation"), F.regexp_extract(text, p, 2).alias("definition")))


def cursor_encode(*keys: Column) -> Column:
    """Opaque page cursor: URL-safe base64 of a JSON array, without padding."""
    raw = F.base64(F.encode(F.to_json(F.array(*[k.cast("string") for k in keys])), "UTF-8"))
    return F.translate(F.regexp_replace(raw, "[\r\n=]", ""), "+/", "-_")


def cursor_decode(cursor: Column) -> Column:
    return F.from_json(F.decode(F.unbase64(F.translate(cursor, "-_", "+/")), "UTF-8"), "array<string>")


def general_text(x: Column) -> Column:
    """A double with up to 15 significant digits: no trailing zeros, an exponent below 1e-4 and from 1e15 on; null as empty, zero as 0.

    Where the shortest digits that name the double are 16 and end in 5, they round up; its exact value may lie just below.
    """
    shown = F.format_string("%.14e", x)
    sign = F.when(shown.startswith("-"), "-").otherwise("")
    digits = F.regexp_replace(F.regexp_replace(F.regexp_replace(shown, "e.*$", ""), "[-.]", ""), "0+$", "")
    power = F.regexp_extract(shown, "e([+-][0-9]+)$", 1).try_cast("int")
    rest = lambda n: F.when(F.length(digits) > n, F.concat(F.lit("."), F.substr(digits, n + 1))).otherwise("")
    far = F.concat(F.substr(digits, F.lit(1), F.lit(1)), rest(F.lit(1)), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    far = F.when(F.abs(power) > 99, F.concat(F.substr(digits, F.lit(1), F.lit(1)), rest(F.lit(1)), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.abs(power).cast("string"))).otherwise(far)
    whole = F.rpad(F.substr(digits, F.lit(1), power + 1), power + 1, F.lit("0"))
    fixed = F.when(power >= 0, F.concat(whole, rest(power + 1))).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
    odd = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    return F.coalesce(odd, F.when(x == 0, "0").otherwise(F.concat(sign, F.when((power < -4) | (power >= 15), far).otherwise(fixed))), F.lit(""))


def iso_utc(ts: Column) -> Column:
    """A time in UTC with Z, its microseconds where it has any."""
    u = F.to_utc_timestamp(ts, F.current_timezone())
    shown = F.date_format(u, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.regexp_replace(shown, "[.]000000Z$", "Z")


def quantity_label(kind: Column, context: Column) -> Column:
    return F.concat_ws(":", kind, F.nullif(context, F.lit("")))


def role_token(token: Column) -> Column:
    """(id, role) of ``id:role``; null where either is empty."""
    p = r"^([^:\s]+):([a-z_]+)$"
    return F.when(token.rlike(p), F.struct(F.regexp_extract(token, p, 1).alias("id"), F.regexp_extract(token, p, 2).alias("role")))


#: Parts of layer names by role, in order; the last ones count as whole words only.
BACKGROUND_NAMES = ("furniture", "space", "data device", "color fill", "colour fill", "fill")
FOREGROUND_NAMES = ("tag", "center line", "centerline", "centre line")
SERVICE_NAMES = ("pipe", "drain", "sanitary", "fitting", "waste", "stack", "gully")
SERVICE_WORDS = ("svp", "vp", "cdp", "rwp", "rise", "drop", "vent")


def layer_role(name: Column, saturation: float = 0.3, lightness: float = 0.5) -> Column:
    """Role of a layer: by colour where its name is a pen's (``pen-RRGGBB-w...``), vivid services, pale background, dark
    foreground; else by the first part of the name that is known, background before foreground before services."""
    pen = r"^pen-([0-9a-fA-F]{6})-w"
    r, g, b = colour_channels(F.nullif(F.regexp_extract(name, pen, 1), F.lit("")))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    vivid = F.when(top > 0, (top - low) / top).otherwise(0.0) >= saturation
    by_colour = F.when(vivid, "services").when((r + g + b) / 765.0 >= lightness, "background").otherwise("foreground")
    n = F.lower(name)
    words = rf"(?<![a-z])(?:{'|'.join(SERVICE_WORDS)})(?![a-z])"
    by_name = first_rule([(n.rlike("|".join(BACKGROUND_NAMES)), "background"), (n.rlike("|".join(FOREGROUND_NAMES)), "foreground"), (n.rlike(f"{'|'.join(SERVICE_NAMES)}|{words}"), "services")], "unknown")
    return F.when(name.rlike(pen), by_colour).otherwise(by_name)


def polyline_text(points: Column) -> Column:
    return F.to_json(points)


def text_polyline(text: Column) -> Column:
    return F.from_json(text, "array<struct<x:double,y:double>>")
