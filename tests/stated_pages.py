"""Page rasters on small pictures drawn here: ink, components, lines, rules, boxes, skew, warping and comparison."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docloom.operators import raster
from tests.stated_text import values

QUERIES, SQL = {}, {}


def page(name: str, drawn: list[Callable[[], np.ndarray]], kernel: Callable[[np.ndarray], object], expected: list[str]) -> None:
    """Runs a kernel over pages, one per drawing; what it gives is shown as text."""

    def run(spark: SparkSession, sf_dir: str):
        pages = []
        for i, draw in enumerate(drawn, 1):
            g = draw().astype(np.uint8)
            pages.append((i, g.shape[1], g.shape[0], bytearray(g.tobytes())))
        df = spark.createDataFrame(pages, "page_id long, w int, h int, gray binary")
        return raster.per_page(df, lambda g: [{"out": shown(kernel(g))}], "out string").select(F.col("page_id").alias("id"), "out")

    QUERIES[name], SQL[name] = run, values(list(enumerate(expected, 1)))


def shown(x: object) -> str:
    if isinstance(x, np.ndarray):
        return "/".join("".join("#" if v else "." for v in row) for row in x) if x.dtype == bool else str(x.tolist())
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(shown, x)) + "]"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x)).lower()
    if isinstance(x, (float, np.floating)):
        return f"{x:.6g}"
    return str(x)


def white(h: int, w: int) -> np.ndarray:
    return np.full((h, w), 255, np.uint8)


def inked(h: int, w: int, *boxes: tuple[int, int, int, int], ground: int = 255, ink: int = 0) -> np.ndarray:
    """A page with filled rectangles (y0, x0, y1, x1), ends exclusive."""
    g = np.full((h, w), ground, np.uint8)
    for y0, x0, y1, x1 in boxes:
        g[y0:y1, x0:x1] = ink
    return g


def framed(h: int, w: int, *boxes: tuple[int, int, int, int]) -> np.ndarray:
    """A page with the outlines of rectangles (y0, x0, y1, x1), ends inclusive."""
    g = white(h, w)
    for y0, x0, y1, x1 in boxes:
        g[[y0, y1], x0 : x1 + 1] = 0
        g[y0 : y1 + 1, [x0, x1]] = 0
    return g


def dark(g: np.ndarray) -> np.ndarray:
    return g < 128


def bits(*rows: str) -> Callable[[], np.ndarray]:
    return lambda: np.array([[0 if c == "#" else 255 for c in r] for r in rows], np.uint8)


page("connected_areas", [bits("#.#", ".#.", "...", "##."), bits("...")], lambda g: raster.components(dark(g)), ["[[0, 0, 2, 1, 3], [0, 3, 1, 3, 2]]", "[]"])
page("connected_by_sides", [bits("#.", ".#")], lambda g: raster.components(dark(g), eight=False), ["[[0, 0, 0, 0, 1], [1, 1, 1, 1, 1]]"])
page("cleaned_masks", [bits(".....", ".##..", ".##..", "....." , "....#")], lambda g: raster.clean(dark(g), 3), ["...../.##../.##../...../....."])
page("text_lines", [lambda: inked(60, 40, (5, 5, 15, 35), (25, 5, 35, 35), (45, 5, 55, 35)), lambda: inked(60, 40, (5, 5, 15, 35), (16, 5, 18, 9), (25, 5, 35, 35))], lambda g: raster.lines(dark(g)), ["[[5, 15], [25, 35], [45, 55]]", "[[5, 18], [25, 35]]"])
page("column_lines", [lambda: inked(20, 60, (2, 2, 6, 20), (10, 2, 14, 20), (2, 40, 6, 58))], lambda g: raster.column_lines(dark(g), 10), ["[[2, 2, 20, 6], [2, 10, 20, 14], [40, 2, 58, 6]]"])
page("ruled_rows", [lambda: inked(20, 50, (3, 0, 4, 50), (9, 0, 10, 30))], lambda g: raster.horizontal_rules(dark(g), 0.8), ["[[3, 4]]"])
page("ruled_columns", [lambda: inked(50, 20, (0, 7, 50, 9))], lambda g: raster.vertical_rules(dark(g), 0.8), ["[[7, 9]]"])
page("broken_rules", [lambda: inked(20, 50, (3, 0, 4, 20), (3, 23, 4, 50), (9, 0, 10, 20), (9, 30, 10, 50))], lambda g: raster.horizontal_rules(dark(g), 0.8, gap=4), ["[[3, 4]]"])
page("box_frames", [lambda: framed(60, 60, (5, 5, 40, 50))], lambda g: raster.frames(dark(g)), ["[[5, 5, 50, 40]]"])
page("page_frames", [lambda: framed(100, 80, (2, 2, 97, 77)), lambda: framed(100, 80, (2, 2, 97, 77), (6, 6, 93, 73)), lambda: white(100, 80)], lambda g: raster.page_frame(dark(g)), ["single", "double", "none"])
page("digit_boxes", [lambda: framed(40, 100, *((10, 5 + 20 * i, 22, 17 + 20 * i) for i in range(4)))], lambda g: raster.digit_boxes(dark(g)), ["[[[5, 10, 17, 22], [25, 10, 37, 22], [45, 10, 57, 22], [65, 10, 77, 22]]]"])
page("grid_cells", [lambda: framed(61, 61, (0, 0, 60, 60), (0, 0, 30, 60), (0, 0, 60, 20))], lambda g: raster.grid(dark(g)), ["[[[0, 0, 20, 30], [20, 0, 60, 30]], [[0, 30, 20, 60], [20, 30, 60, 60]]]"])
page("shaded_blocks", [lambda: inked(70, 70, (0, 0, 20, 20), ink=225), lambda: white(70, 70)], lambda g: raster.shade(g, (0, 0, 19, 19)), ["30", "None"])
page("dark_bands", [lambda: np.where(np.add.outer(np.zeros(10), np.arange(10) == 4) > 0, 250, 20)], lambda g: int(raster.dark_band(g, (0, 0, 9, 9)).sum()), ["10"])
page("grown_crops", [lambda: inked(40, 40, (10, 10, 20, 30))], lambda g: raster.grown(dark(g), (8, 8, 25, 25)), ["[10, 10, 29, 19]"])
page("whitened_pages", [lambda: inked(30, 30, (5, 5, 10, 10), ground=200, ink=50)], lambda g: [int(raster.whitened(g).max()), int(raster.whitened(g).min())], ["[255, 63]"])
page("luminance", [lambda: inked(2, 2, ground=7)], lambda g: [float(raster.luma(g)[0, 0]), float(raster.luma(np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255]]], np.uint8))[0, 1])], ["[7, 149.685]"])
page("thresholds", [lambda: inked(20, 20, (0, 0, 10, 20), ground=200, ink=100), lambda: white(5, 5)], lambda g: raster.otsu(g), ["160", "160"])
page("wide_thresholds", [lambda: inked(20, 20, (0, 0, 10, 20), ground=200, ink=100)], lambda g: raster.otsu(g, 0, 255), ["100"])
page("ink_masks", [lambda: inked(4, 6, (1, 1, 3, 3))], lambda g: raster.ink(g), ["....../.##.../.##.../......"])
page("tiled_ink", [lambda: inked(20, 20, (5, 5, 10, 10), ink=20)], lambda g: int(raster.ink(g, tiles=2).sum()), ["25"])
page("paper_brightness", [lambda: inked(70, 70, (0, 0, 30, 70), ground=240, ink=10)], lambda g: raster.background(g), ["240"])
page("sharpness", [lambda: np.full((20, 20), 50), lambda: np.full((20, 20), 200), lambda: np.tile([0, 255], (20, 10))], lambda g: raster.blur_of(g)["verdict"], ["dark", "blurred", "good"])
page("spread_pages", [lambda: inked(50, 100, (5, 5, 45, 42), (5, 58, 45, 95)), lambda: inked(100, 50, (5, 5, 95, 45))], lambda g: (lambda at: at is not None and 42 <= at < 58)(raster.spread(dark(g))), ["true", "false"])
page("content_boxes", [lambda: inked(100, 200, (20, 50, 60, 120)), lambda: white(10, 20)], lambda g: raster.content_box(dark(g)), ["[44, 17, 125, 62]", "[0, 0, 19, 9]"])
page("page_corners", [lambda: inked(100, 100, (10, 20, 90, 80), ground=0, ink=255), lambda: np.zeros((50, 50))], lambda g: raster.corners(g > 128), ["[[20, 10], [79, 10], [79, 89], [20, 89]]", "None"])
page("reliable_corners", [lambda: white(100, 100)], lambda g: [raster.reliable(np.array(q), 100, 100) for q in ([[0, 0], [99, 0], [99, 99], [0, 99]], [[0, 0], [20, 0], [20, 20], [0, 20]], [[0, 0], [99, 99], [99, 0], [0, 99]])], ["[true, false, false]"])
page("warped_pages", [lambda: np.add.outer(np.arange(20) * 5, np.arange(30) * 3)], lambda g: int(np.abs(raster.warped(g, np.array([[5, 2], [24, 2], [24, 11], [5, 11]]), 20, 10).astype(int) - g[2:12, 5:25]).max()), ["0"])
page("homographies", [lambda: white(2, 2)], lambda g: [[float(v) for v in np.round(raster.homography(np.array([[0, 0], [1, 0], [1, 1], [0, 1]]), np.array([[2, 3], [4, 3], [4, 5], [2, 5]])) @ p, 9)] for p in ([0, 0, 1], [0.5, 0.5, 1])], ["[[2, 3, 1], [3, 4, 1]]"])
page("even_light", [lambda: np.full((60, 60), 100)], lambda g: int(raster.equalized(g, 5)[30, 30]), ["235"])
page("skew_angles", [lambda: inked(100, 200, *((y, 20, y + 4, 180) for y in range(10, 90, 16)))], lambda g: [raster.skew(dark(g)), abs(raster.skew(dark(raster.levelled(g, -3.0))) - 3.0) <= 0.25], ["[0, true]"])
page("sideways_pages", [lambda: inked(100, 200, *((y, 20, y + 4, 180) for y in range(10, 90, 16)))], lambda g: raster.orientation(dark(g)), ["0"])


def _text_page() -> np.ndarray:
    g = white(420, 300)
    for y in range(40, 380, 30):
        # a headline with strokes below it, and a ragged right margin
        end = 240 + y % 37
        g[y : y + 3, 30:end] = 0
        g[y + 3 : y + 14, 30:end:7] = 0
    return g


page("turned_pages", [_text_page, lambda: np.rot90(_text_page()), lambda: np.rot90(_text_page(), -1)], lambda g: raster.orientation(raster.ink(g)), ["0", "90", "270"])
page("prepared_pages", [_text_page, lambda: np.rot90(_text_page()), lambda: np.rot90(_text_page(), -1)], lambda g: bool(np.array_equal(raster.prepared(g)[0], raster.prepared(_text_page())[0])), ["true"] * 3)
page("ink_agreement", [lambda: inked(40, 40, (10, 10, 20, 30))], lambda g: [raster.ink_f1(dark(g), dark(g), 0), raster.ink_f1(dark(g), np.roll(dark(g), 1, 1), 1), raster.ink_f1(dark(g), ~dark(g), 0), raster.ink_f1(np.zeros((3, 3), bool), np.zeros((3, 3), bool), 1)], ["[1, 1, 0, 1]"])
page("thinned_strokes", [lambda: inked(9, 24, (3, 2, 6, 22))], lambda g: (lambda s: [int(s.sum()) <= 20, bool(s[4].any()), not s[3].any()])(raster.skeleton(dark(g))), ["[true, true, true]"])
page("shifted_profiles", [lambda: white(2, 2)], lambda g: (lambda r: [r[0], round(r[1], 6)])(raster.shift_correlation(np.sin(np.arange(50)), np.sin(np.arange(50) + 2), 5)), ["[2, 1]"])
page("block_measures", [lambda: inked(60, 100, *((y, 10, y + 10, 90) for y in (5, 25, 45)))], lambda g: (lambda m: [m["lines"], m["font_pt"], m["pitch_pt"]])(raster.block_metrics(dark(g), (0, 0, 99, 59), 72)), ["[3, 17.5, 20]"])
page("aligned_bands", [lambda: white(2, 2)], lambda g: [raster.aligned([(0, 10), (20, 30)], [(1, 11), (50, 60)], 100), raster.aligned([(0, 10), (20, 30), (40, 50)], [(2, 12), (41, 51)], 100)], ["[[[0, 0]], [[0, 0], [2, 1]]]"])
page("rows_in_bands", [lambda: white(2, 2)], lambda g: [raster.rows_in_bands([1, 2, 1], [1, 3], [False] * 3), raster.rows_in_bands([1, 1], [1, 0, 1], [False, False])], ["[[0, 1, 1], [0, 2]]"])
page("profile_spread", [lambda: inked(4, 4, (1, 0, 2, 4))], lambda g: float(dark(g).sum(axis=1).var()), ["3"])
page("cropped_figures", [lambda: inked(40, 60, (10, 10, 20, 30))], lambda g: [list(c.shape) for c in raster.figures(g, [(200, 100, 600, 700), (0, 0, 1000, 1000)])], ["[[10, 20], [40, 60]]"])
