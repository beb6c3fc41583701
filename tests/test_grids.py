"""Places of cells in tables, against a matrix."""

import random
from collections import Counter, defaultdict

from tessella.operators import grids
from tessella.plans import registry
from tessella.sources import markup


def matrix(cells):
    """(places, dimensions) of one table's (row, pos, colspan, rowspan)."""
    lines = sorted({r for r, *_ in cells})
    grid, places = defaultdict(int), []
    overlapping = hanging = 0
    for k, line in enumerate(lines):
        at = 0
        for _, pos, wide, high in sorted(c for c in cells if c[0] == line):
            while grid[k, at]:
                at += 1
            over = sum(grid[k, c] > 0 for c in range(at, at + wide))
            places.append((line, pos, at, wide, high, over))
            overlapping += over > 0
            hanging += k + high > len(lines)
            for c in range(at, at + wide):
                for r in range(k, k + high):
                    grid[r, c] += 1
            at += wide
    columns = max(at + wide for _, _, at, wide, *_ in places)
    ragged = sum(sum(grid[k, c] > 0 for c in range(columns)) < columns for k in range(len(lines)))
    return places, (len(lines), columns, ragged, overlapping, hanging)


def test_cells(spark):
    r = random.Random(12)
    tables = {f"t{k}": [(row, pos, r.choice([1, 1, 1, 2, 3]), r.choice([1, 1, 2, 4])) for row in r.sample(range(9), r.randint(1, 6)) for pos in range(r.randint(1, 5))] for k in range(60)}
    rows = [(t, *c) for t, cells in tables.items() for c in cells] + [("odd", 1, 1, 0, None), ("odd", 1, 2, None, -3), (None, 1, 1, 1, 1)]
    tables["odd"] = [(1, 1, 1, 1), (1, 2, 1, 1)]
    df = spark.createDataFrame(rows, "table string, row int, pos int, colspan int, rowspan int").repartition(3)
    placed = grids.placed(df)
    assert sorted(map(tuple, placed.collect())) == sorted((t, *p) for t, cells in tables.items() for p in matrix(cells)[0])
    got = {x.table: (x.rows, x.columns, x.ragged, x.overlapping, x.hanging) for x in grids.dimensions(placed).collect()}
    assert got == {t: matrix(cells)[1] for t, cells in tables.items()}
    assert grids.dimensions(grids.placed(df.where("false"))).collect() == []


def test_tables_in_markup(spark):
    html = "<table><thead><tr><th colspan=2>a<th rowspan='3'>b</tr></thead><tr><td>c<td><table><tr><td>inner</td></tr></table></td></tr><tr><td colspan=x>d</td></tr></table><p><td>no row</td>"
    nodes = markup.nodes(spark.createDataFrame([("f", html), ("g", "<p>none</p>")], "file string, html string"), "file", "html")
    got = {x.table: (x.rows, x.columns, x.ragged, x.overlapping, x.hanging) for x in grids.dimensions(grids.placed(grids.cells_of(nodes))).collect()}
    assert sorted(got.values()) == [(1, 1, 0, 0, 0), (3, 3, 1, 0, 0)]


def test_query(spark, sf_dir):
    tables = defaultdict(list)
    for x in spark.read.parquet(f"{sf_dir}/lineitem.parquet").collect():
        tables[x.l_orderkey].append((x.l_linenumber // 3, x.l_linenumber, 1 + int(x.l_quantity) % 3, 1 + x.l_partkey % 2))
    want = Counter(matrix(cells)[1] for cells in tables.values())
    found = registry.QUERIES["table_grids"](spark, sf_dir).collect()
    assert {(x.rows, x.columns, x.ragged, x.overlapping, x.hanging): x.n for x in found} == want
