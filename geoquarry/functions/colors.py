"""Colour ramps, palette and named colours."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ramp colours at positions of 0..255; between them colours are interpolated.
RAMP_ANCHORS: dict[str, dict[int, str]] = {
    "viridis": {
        0: "#440154", 42: "#443983", 51: "#414487", 63: "#3b528b", 85: "#31688e",
        102: "#2a788e", 127: "#21918c", 153: "#22a884", 170: "#35b779", 191: "#5ec962",
        204: "#7ad151", 212: "#90d743", 255: "#fde725",
    },
    "plasma": {
        0: "#0d0887", 51: "#6a00a8", 63: "#7e03a8", 85: "#9c179e", 102: "#b12a90",
        127: "#cc4778", 153: "#e16462", 170: "#ed7953", 191: "#f89540", 204: "#fca636",
        255: "#f0f921",
    },
    "inferno": {
        0: "#000004", 51: "#420a68", 63: "#57106e", 85: "#781c6d", 102: "#932667",
        127: "#bc3754", 153: "#dd513a", 170: "#ed6925", 191: "#f98e09", 204: "#fca50a",
        255: "#fcffa4",
    },
    "magma": {
        0: "#000004", 51: "#3b0f70", 63: "#51127c", 85: "#721f81", 102: "#8c2981",
        127: "#b73779", 153: "#de4968", 170: "#f1605d", 191: "#fc8961", 204: "#fe9f6d",
        255: "#fcfdbf",
    },
}

# Ramps of nine equally spaced colours.
_NINE_CLASS_RAMPS = {
    "Greens": "#f7fcf5 #e5f5e0 #c7e9c0 #a1d99b #74c476 #41ab5d #238b45 #006d2c #00441b",
    "Blues": "#f7fbff #deebf7 #c6dbef #9ecae1 #6baed6 #4292c6 #2171b5 #08519c #08306b",
    "Reds": "#fff5f0 #fee0d2 #fcbba1 #fc9272 #fb6a4a #ef3b2c #cb181d #a50f15 #67000d",
    "Oranges": "#fff5eb #fee6ce #fdd0a2 #fdae6b #fd8d3c #f16913 #d94801 #a63603 #7f2704",
    "Purples": "#fcfbfd #efedf5 #dadaeb #bcbddc #9e9ac8 #807dba #6a51a3 #54278f #3f007d",
    "Greys": "#ffffff #f0f0f0 #d9d9d9 #bdbdbd #969696 #737373 #525252 #252525 #000000",
    "YlOrRd": "#ffffcc #ffeda0 #fed976 #feb24c #fd8d3c #fc4e2a #e31a1c #bd0026 #800026",
    "YlGnBu": "#ffffd9 #edf8b1 #c7e9b4 #7fcdbb #41b6c4 #1d91c0 #225ea8 #253494 #081d58",
}
for _name, _colors in _NINE_CLASS_RAMPS.items():
    RAMP_ANCHORS[_name] = {i * 255 / 8: c for i, c in enumerate(_colors.split())}

# Our own palette for categories.
PALETTE = (
    "#2f6fde #e4572e #3fa34d #8e44ad #f2a541 #17a2b8 #d6336c #7f5539 #94b447 #5c4d9b"
).split()
NAN_COLOR = "#969696"
NAN_LABEL = "Missing"

# CSS colour names.
NAMED_COLORS = dict(
    line.split()
    for line in """\
aliceblue #f0f8ff
antiquewhite #faebd7
aqua #00ffff
aquamarine #7fffd4
azure #f0ffff
beige #f5f5dc
bisque #ffe4c4
black #000000
blanchedalmond #ffebcd
blue #0000ff
blueviolet #8a2be2
brown #a52a2a
burlywood #deb887
cadetblue #5f9ea0
chartreuse #7fff00
chocolate #d2691e
coral #ff7f50
cornflowerblue #6495ed
cornsilk #fff8dc
crimson #dc143c
cyan #00ffff
darkblue #00008b
darkcyan #008b8b
darkgoldenrod #b8860b
darkgray #a9a9a9
darkgreen #006400
darkgrey #a9a9a9
darkkhaki #bdb76b
darkmagenta #8b008b
darkolivegreen #556b2f
darkorange #ff8c00
darkorchid #9932cc
darkred #8b0000
darksalmon #e9967a
darkseagreen #8fbc8f
darkslateblue #483d8b
darkslategray #2f4f4f
darkslategrey #2f4f4f
darkturquoise #00ced1
darkviolet #9400d3
deeppink #ff1493
deepskyblue #00bfff
dimgray #696969
dimgrey #696969
dodgerblue #1e90ff
firebrick #b22222
floralwhite #fffaf0
forestgreen #228b22
fuchsia #ff00ff
gainsboro #dcdcdc
ghostwhite #f8f8ff
gold #ffd700
goldenrod #daa520
gray #808080
green #008000
greenyellow #adff2f
grey #808080
honeydew #f0fff0
hotpink #ff69b4
indianred #cd5c5c
indigo #4b0082
ivory #fffff0
khaki #f0e68c
lavender #e6e6fa
lavenderblush #fff0f5
lawngreen #7cfc00
lemonchiffon #fffacd
lightblue #add8e6
lightcoral #f08080
lightcyan #e0ffff
lightgoldenrodyellow #fafad2
lightgray #d3d3d3
lightgreen #90ee90
lightgrey #d3d3d3
lightpink #ffb6c1
lightsalmon #ffa07a
lightseagreen #20b2aa
lightskyblue #87cefa
lightslategray #778899
lightslategrey #778899
lightsteelblue #b0c4de
lightyellow #ffffe0
lime #00ff00
limegreen #32cd32
linen #faf0e6
magenta #ff00ff
maroon #800000
mediumaquamarine #66cdaa
mediumblue #0000cd
mediumorchid #ba55d3
mediumpurple #9370db
mediumseagreen #3cb371
mediumslateblue #7b68ee
mediumspringgreen #00fa9a
mediumturquoise #48d1cc
mediumvioletred #c71585
midnightblue #191970
mintcream #f5fffa
mistyrose #ffe4e1
moccasin #ffe4b5
navajowhite #ffdead
navy #000080
oldlace #fdf5e6
olive #808000
olivedrab #6b8e23
orange #ffa500
orangered #ff4500
orchid #da70d6
palegoldenrod #eee8aa
palegreen #98fb98
paleturquoise #afeeee
palevioletred #db7093
papayawhip #ffefd5
peachpuff #ffdab9
peru #cd853f
pink #ffc0cb
plum #dda0dd
powderblue #b0e0e6
purple #800080
rebeccapurple #663399
red #ff0000
rosybrown #bc8f8f
royalblue #4169e1
saddlebrown #8b4513
salmon #fa8072
sandybrown #f4a460
seagreen #2e8b57
seashell #fff5ee
sienna #a0522d
silver #c0c0c0
skyblue #87ceeb
slateblue #6a5acd
slategray #708090
slategrey #708090
snow #fffafa
springgreen #00ff7f
steelblue #4682b4
tan #d2b48c
teal #008080
thistle #d8bfd8
tomato #ff6347
turquoise #40e0d0
violet #ee82ee
wheat #f5deb3
white #ffffff
whitesmoke #f5f5f5
yellow #ffff00
yellowgreen #9acd32
""".splitlines()
)


def to_hex(color: str) -> str:
    """Hex code of a named colour or of ``#rgb`` / ``#rrggbb`` text."""
    text = color.strip().lower()
    if text in NAMED_COLORS:
        return NAMED_COLORS[text]
    if re.fullmatch(r"#[0-9a-f]{6}", text):
        return text
    if re.fullmatch(r"#[0-9a-f]{3}", text):
        return "#" + "".join(2 * c for c in text[1:])
    raise ValueError(f"Unknown colour: {color!r}")


def named_color(column: Column) -> Column:
    """Hex code of a column of colour names or hex codes; unknown names give null."""
    text = F.lower(F.trim(column))
    pairs = [F.lit(v) for item in NAMED_COLORS.items() for v in item]
    return F.coalesce(
        F.try_element_at(F.create_map(*pairs), text),
        F.when(text.rlike("^#[0-9a-f]{6}$"), text),
        F.when(
            text.rlike("^#[0-9a-f]{3}$"),
            F.regexp_replace(text, "([0-9a-f])", "$1$1"),
        ),
    )


def ramp(name: str, colors: int) -> list[str]:
    """``colors`` hex codes at equal steps (cut to whole positions) along a ramp."""
    if name not in RAMP_ANCHORS:
        raise ValueError(f"Unknown ramp {name!r}; known: {sorted(RAMP_ANCHORS)}")
    anchors = sorted(RAMP_ANCHORS[name].items())

    def at(position: int) -> str:
        if position >= 255:
            return anchors[-1][1]
        right = next(i for i, (p, _) in enumerate(anchors) if p > position)
        (p0, c0), (p1, c1) = anchors[right - 1], anchors[right]
        share = (position - p0) / (p1 - p0)
        channels = [
            round(int(c0[i : i + 2], 16) * (1 - share) + int(c1[i : i + 2], 16) * share)
            for i in (1, 3, 5)
        ]
        return "#" + "".join(f"{c:02x}" for c in channels)

    step = 255 / (colors - 1) if colors > 1 else 0
    return [at(int(i * step)) for i in range(colors)]


def hashed_color(value: Column, min_diff: int = 50) -> Column:
    """A fixed colour of a text value that is not too grey.

    The colour is read from the value's MD5. When red is too close to green and blue together
    it is shifted by half its range, which always moves it far enough away.
    """
    digest = F.md5(value.cast("string"))

    def channel(start: int) -> Column:
        return F.conv(F.substring(digest, start, 2), 16, 10).cast("int")

    red, green, blue = channel(1), channel(3), channel(5)
    grey = F.abs(red - green) + F.abs(red - blue) <= min_diff
    shifted = F.when(grey, F.pmod(red + 128, F.lit(256))).otherwise(red)
    code = F.concat(F.lpad(F.hex(shifted), 2, "0"), F.substring(digest, 3, 4))
    return F.concat(F.lit("#"), F.lower(code))
