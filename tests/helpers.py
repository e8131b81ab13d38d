import random

FRAME = "frame_id string, frame_no int, width int, height int, x_res double, y_res double"
CELL = "frame_id string, x int, y int, h double"


def random_grid(w, h, top, seed):
    rng = random.Random(seed)
    return [[float(rng.randint(0, top)) for _ in range(w)] for _ in range(h)]


def to_tables(spark, grids, x_res=1.0, y_res=1.0):
    cells = [(f, x, y, v) for f, g in grids.items() for y, row in enumerate(g) for x, v in enumerate(row)]
    frames = [(f, i, len(g[0]), len(g), x_res, y_res) for i, (f, g) in enumerate(sorted(grids.items()))]
    return spark.createDataFrame(cells, CELL), spark.createDataFrame(frames, FRAME)
