"""Best right row in a cone around each left row, searched down a pyramid of sky cells.

The right side is summed up once: every cell that a search may enter, from the
cells as large as the cone down to single positions, has a node with the box around
its positions and the first of its rows in the wanted order. A search starts at the
few large cells its cone reaches and carries the best row met so far. It opens a
node only if the node's box comes nearer than that row (nearest), or meets the cone
and holds a row that comes before it (ranked). Every cell is cut in 16 by 16, so
that an opened node has at most 256 nodes below it, and nothing is compared with
all rows of a crowded cell. Below the finest cells, 1/65536 of a large one wide, come
the positions themselves, so the search is exact at any density.

All of it is one lazy plan: one read of each side, no job while it is built.
A large cell of few positions stands there with these instead of a node, so that rows
of sparse places are settled at the first meeting; only searches with nodes left to
open take part in the joins below, which Spark leaves out where there are none.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from skysift.functions import sky

# A cell is cut in 2^BITS by 2^BITS, LEVELS times. This bounds the joins of a plan, not what they find:
# what shares a finest cell is searched by position.
BITS, LEVELS = 4, 4
FINEST = BITS * LEVELS

# A large cell of at most so many positions has no node; a search meets these at once.
LEAF = 64

# Distances are compared with this much room for rounding (a part, and arc seconds).
SLACK, SLACK_ARCSEC = 1e-9, 1e-6


def _zone(dec: str, height: float) -> str:
    return f"CAST(floor(({dec} + 90) / {height!r}D) AS BIGINT)"


def _zone_cells(zone: str, height: float) -> str:
    widest = f"least(greatest(abs({zone} * {height!r}D - 90), abs(({zone} + 1) * {height!r}D - 90)), 90D)"
    return f"CAST(greatest(floor(360D * cos(radians({widest})) / {height!r}D), 1) AS BIGINT)"


def _placed(table: str, ra: str, dec: str, height: float) -> str:
    """Add _turn, the right ascension within a turn, and the large cell _hz, _hc of a position, with _cells in its zone."""
    zoned = f"SELECT *, pmod({ra}, 360D) AS _turn, {_zone(dec, height)} AS _hz FROM {table}"
    counted = f"SELECT *, {_zone_cells('_hz', height)} AS _cells FROM ({zoned})"
    return f"SELECT *, least(CAST(floor(_turn / 360 * _cells) AS BIGINT), _cells - 1) AS _hc FROM ({counted})"


def _separation(ra1: str, dec1: str, ra2: str, dec2: str) -> str:
    """The distance of `sky.separation_arcsec`, operation by operation."""
    half_dec, half_ra = f"sin(radians({dec2} - {dec1}) / 2)", f"sin(radians({ra2} - {ra1}) / 2)"
    h = f"({half_dec} * {half_dec} + cos(radians({dec1})) * cos(radians({dec2})) * {half_ra} * {half_ra})"
    return f"degrees(2 * asin(sqrt(least({h}, 1D)))) * {sky.ARCSEC!r}D"


def _box_distance(turn: str, dec: str) -> str:
    """A lower bound, in arc seconds, of the distance from a position to anything in a node's box."""
    aside = f"least(pmod(ra_lo - {turn}, 360D), pmod({turn} - ra_hi, 360D))"
    # Distance to the nearer edge's meridian; beyond a quarter turn the pole is nearer than that.
    sine = f"cos(radians({dec})) * CASE WHEN {aside} < 90 THEN sin(radians({aside})) ELSE 1D END"
    across = f"CASE WHEN {turn} >= ra_lo AND {turn} <= ra_hi THEN 0D ELSE degrees(asin(least({sine}, 1D))) END"
    return f"greatest(dec_lo - {dec}, {dec} - dec_hi, 0D, {across}) * {sky.ARCSEC!r}D"


BOX = "min(row) AS row, min(row.turn) AS ra_lo, max(row.turn) AS ra_hi, min(row.dec) AS dec_lo, max(row.dec) AS dec_hi"
OPEN = "(ra_lo < ra_hi OR dec_lo < dec_hi)"


def _reaching(radius: float, height: float) -> str:
    """One row per entry and large cell (_zone, _cell) from whose positions it can be reached."""
    r = sky._reach(radius)
    zones = f"sequence({_zone(f'greatest(dec_lo - {r!r}D, -90D)', height)}, {_zone(f'least(dec_hi + {r!r}D, 90D)', height)})"
    # A circle around a position of the box is widest in right ascension where the box is nearest to a pole.
    steep = "greatest(abs(dec_lo), abs(dec_hi))"
    wide = f"{math.sin(math.radians(r))!r}D / cos(radians({steep}))"
    half = f"CASE WHEN {steep} + {r!r}D >= 90 OR {wide} >= 1 THEN 180D ELSE degrees(asin(least({wide}, 1D))) + 1e-9D END"
    return f"""SELECT row, ra_lo, ra_hi, dec_lo, dec_hi, _nz, _nc, _zone, pmod(_k, _n) AS _cell FROM (
        SELECT *, explode(sequence(_first, least(CAST(floor((ra_hi + _half) / 360 * _n) AS BIGINT), _first + _n - 1))) AS _k FROM (
          SELECT *, CAST(floor((ra_lo - _half) / 360 * _n) AS BIGINT) AS _first FROM (
            SELECT *, {half} AS _half, {_zone_cells('_zone', height)} AS _n FROM (
              SELECT row, ra_lo, ra_hi, dec_lo, dec_hi, _z AS _nz, _c AS _nc, explode({zones}) AS _zone FROM {{entries}}))))"""


def search(left: DataFrame, right: DataFrame, radius: float, nearest: bool, left_keep: list[str]) -> DataFrame:
    """One row per left_id that has a right row in its cone: left_id, left_keep, sep and the struct `values` of that row.

    Left has left_id, left_ra, left_dec and left_keep; right has ra, dec, the struct `values` and the struct
    `order`, by which its rows come in ascending order; it must be unique.
    """
    height = sky.zone_height(radius)
    lefts = ", ".join(f"`{c}`" for c in ["left_id", "left_ra", "left_dec", *left_keep])
    sizes = "'sep', sep, 'order', row.order" if nearest else "'order', row.order, 'sep', sep"
    found = f"CASE WHEN sep <= {radius!r}D THEN named_struct({sizes}, 'values', row.values) END"
    room = f"{radius * (1 + SLACK) + SLACK_ARCSEC!r}D"
    # What a node must still offer once a row is met; a node whose first row lies in the cone has nothing better below it.
    if nearest:
        wanted, better = OPEN, f"{{bound}} <= coalesce(best.sep * {1 + SLACK!r}D + {SLACK_ARCSEC!r}D, {room})"
    else:
        wanted, better = f"{OPEN} AND sep > {radius!r}D", "(best IS NULL OR {order} < best.order)"
    open_still = "x -> " + better.format(bound="x.bound", order="x.order")

    def step(text: str, **tables: DataFrame) -> DataFrame:
        return left.sparkSession.sql(text, **tables)

    def met(pairs: DataFrame, best: str) -> DataFrame:
        """One row per left row: the first right row met so far and the nodes still to open."""
        return step(f"""SELECT {lefts}, best, filter(nodes, {open_still}) AS nodes FROM (
            SELECT {lefts}, min({best}) AS best,
                   collect_list(CASE WHEN {wanted} THEN named_struct('z', _nz, 'c', _nc, 'bound', bound, 'order', row.order) END) AS nodes
            FROM (SELECT *, {_separation("left_ra", "left_dec", "row.ra", "row.dec")} AS sep, {_box_distance("pmod(left_ra, 360D)", "left_dec")} AS bound
                  FROM {{pairs}}) GROUP BY {lefts})""", pairs=pairs)

    def below(state: DataFrame, level: int) -> DataFrame:
        # What has nothing to open goes along under a key that no node has. The level is part of the first key, not a key
        # of its own: told that it is constant, Spark would filter by it below the nodes' aggregation and read the right
        # side once for each level. Nodes that can't hold what is sought end at the join.
        mine = f"CASE WHEN node IS NOT NULL THEN node.z * 8 + {level} ELSE -1 - (xxhash64(left_id) & {(1 << 60) - 1}) END"
        pairs = step(f"""SELECT s.*, n.* FROM (SELECT *, {mine} AS _mine, coalesce(node.c, -1) AS _under, pmod(left_ra, 360D) AS _turn FROM (
            SELECT {lefts}, best, explode_outer(nodes) AS node FROM {{state}})) s LEFT JOIN {{nodes}} n ON s._mine = n._key AND s._under = n._parent
            AND {_box_distance("_turn", "left_dec")} <= {room} AND {better.format(bound=_box_distance("_turn", "left_dec"), order='row.order')}""",
                     state=state, nodes=nodes)
        return met(pairs, f"least(best, {found})")

    # Searches from one position find the same row, so one of them is made, however many there are. Both readers of `placed`
    # use its whole row, so that they share one shuffle.
    placed = step(f"""SELECT /*+ REPARTITION(left_ra, left_dec) */ left_ra, left_dec, struct({lefts}) AS mine FROM {{left}}
        WHERE left_ra IS NOT NULL AND left_dec IS NOT NULL""", left=left)
    spots = step("SELECT mine.* FROM (SELECT min(mine) AS mine FROM {placed} GROUP BY left_ra, left_dec)", placed=placed)
    whole = float(1 << FINEST)
    # Rows at one position cannot differ in distance: one of them is enough, however many there are. Every reader of
    # `points` uses its whole row, so that they ask for the same columns and share one shuffle; so do those of `nodes`,
    # for which the last level asks for what is left to open, of which there is nothing.
    points = step(f"""SELECT min(row) AS row FROM (
        SELECT ra, dec, named_struct('order', order, 'values', values, 'ra', ra, 'dec', dec, 'turn', _turn,
          'z', CAST(floor((dec + 90) / {height!r}D * {whole!r}D) AS BIGINT),
          'c', _hc * {1 << FINEST} + CAST(least(greatest(floor((_turn / 360 * _cells - _hc) * {whole!r}D), 0), {(1 << FINEST) - 1}) AS BIGINT)) AS row
        FROM ({_placed("{right}", "ra", "dec", height)})) GROUP BY ra, dec""", right=right)
    roots = step(f"SELECT shiftright(row.z, {FINEST}) AS _z, shiftright(row.c, {FINEST}) AS _c, count(*) AS n, {BOX} FROM {{points}} GROUP BY 1, 2", points=points)
    counted = step(f"""SELECT row, n FROM {{points}} JOIN (SELECT _z, _c, n FROM {{roots}} WHERE row IS NOT NULL)
        ON shiftright(row.z, {FINEST}) = _z AND shiftright(row.c, {FINEST}) = _c""", points=points, roots=roots)
    single = f"level = {LEVELS + 1}"
    nodes = step(f"""SELECT _key, _parent, _nz, _nc, row, ra_lo, ra_hi, dec_lo, dec_hi FROM (
        SELECT shiftright(row.z, above) * 8 + level AS _key, shiftright(row.c, above) AS _parent, shiftright(row.z, own) AS _nz,
               shiftright(row.c, own) AS _nc, CASE WHEN {single} THEN struct(row.turn, row.dec) END AS _at, {BOX}
        FROM (SELECT row, level, greatest({LEVELS} - level, 0) * {BITS} AS own, ({LEVELS + 1} - level) * {BITS} AS above
              FROM (SELECT row, explode(sequence(1, {LEVELS + 1})) AS level FROM {{counted}} WHERE n > {LEAF})) GROUP BY 1, 2, 3, 4, 5)""", counted=counted)
    entries = step(f"""SELECT row, row.turn AS ra_lo, row.turn AS ra_hi, row.dec AS dec_lo, row.dec AS dec_hi, row.z AS _z, row.c AS _c FROM {{counted}} WHERE n <= {LEAF}
        UNION ALL SELECT row, ra_lo, ra_hi, dec_lo, dec_hi, _z, _c FROM {{roots}} WHERE n > {LEAF}""", counted=counted, roots=roots)
    first = step(f"""SELECT * FROM ({_placed("{left}", "left_ra", "left_dec", height)}) l JOIN ({_reaching(radius, height)}) r
        ON _hz = _zone AND _hc = _cell AND {_box_distance("_turn", "left_dec")} <= {room}""", left=spots, entries=entries)
    level0 = met(first, found)
    deeper = step("SELECT * FROM {level0} WHERE size(nodes) > 0", level0=level0)
    for level in range(1, LEVELS + 2):
        deeper = below(deeper, level)
    best = step(f"""SELECT left_ra, left_dec, best FROM {{level0}} WHERE size(nodes) = 0 AND best IS NOT NULL
        UNION ALL SELECT left_ra, left_dec, best FROM {{deeper}} WHERE size(nodes) >= 0 AND best IS NOT NULL""", level0=level0, deeper=deeper)
    # A left id may stand at several positions.
    return step(f"""SELECT left_id, last.best.sep AS sep, last.best.values AS values{''.join(f", last.mine.`{c}`" for c in left_keep)}
        FROM (SELECT mine.left_id AS left_id, min(struct(best, mine)) AS last
              FROM {{placed}} JOIN {{best}} USING (left_ra, left_dec) GROUP BY mine.left_id)""", placed=placed, best=best)
