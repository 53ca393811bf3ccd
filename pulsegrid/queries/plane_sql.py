"""The two principal components in SQL: the matrix of products is squared until only its leading axis is
left, that axis is taken out, and the same again. Each score's sign makes the one of largest size positive."""

from __future__ import annotations

from .binding import RATES_SQL

_SQUARINGS = 18


def _leading(matrix: str, name: str) -> str:
    """``{name}_axis(i, x)`` of length 1 and ``{name}_value(value)`` of a symmetric ``matrix(i, j, v)``."""
    steps = [f"{name}_0 AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM {matrix} WHERE i = j) AS v FROM {matrix})"]
    for k in range(_SQUARINGS):
        steps += [
            f"{name}_sq{k} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {name}_{k} a"
            f" JOIN {name}_{k} b ON a.j = b.i GROUP BY 1, 2)",
            f"{name}_{k + 1} AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM {name}_sq{k} WHERE i = j) AS v"
            f" FROM {name}_sq{k})",
        ]
    last = f"{name}_{_SQUARINGS}"
    return ",\n".join(
        steps
        + [
            f"{name}_column AS MATERIALIZED (SELECT i, v FROM {last} WHERE j = (SELECT arg_max(i, v) FROM {last} WHERE i = j))",
            f"{name}_axis AS MATERIALIZED (SELECT i, v / (SELECT sqrt(sum(v * v)) FROM {name}_column) AS x FROM {name}_column)",
            f"{name}_value AS MATERIALIZED (SELECT sum(a.x * v * b.x) AS value FROM {matrix} m JOIN {name}_axis a ON m.i = a.i"
            f" JOIN {name}_axis b ON m.j = b.i)",
        ]
    )


def _two_axes(matrix: str) -> str:
    """``first_axis``, ``first_value``, ``second_axis``, ``second_value`` of ``matrix``."""
    rest = f"""rest AS MATERIALIZED (SELECT m.i, m.j, v - value * a.x * b.x AS v FROM {matrix} m JOIN first_axis a ON m.i = a.i
    JOIN first_axis b ON m.j = b.i, first_value)"""
    return f"{_leading(matrix, 'first')},\n{rest},\n{_leading('rest', 'second')}"


_UPRIGHT = """plane AS MATERIALIZED (SELECT entity, pc1 * sign((SELECT arg_max(pc1, abs(pc1)) FROM scores)) AS pc1,
    pc2 * sign((SELECT arg_max(pc2, abs(pc2)) FROM scores)) AS pc2 FROM scores)"""

# Centred products of the entities; their axes times the roots of their values are the scores.
RATES_PLANE_SQL = f"""{RATES_SQL},
present AS MATERIALIZED (SELECT DISTINCT entity FROM rates),
met AS (SELECT a.entity AS i, b.entity AS j, sum(a.rate * b.rate) AS v FROM rates a JOIN rates b ON a.item = b.item GROUP BY 1, 2),
products AS MATERIALIZED (SELECT a.entity AS i, b.entity AS j, coalesce(v, 0.0::DOUBLE) AS v
    FROM present a CROSS JOIN present b LEFT JOIN met ON met.i = a.entity AND met.j = b.entity),
centred AS MATERIALIZED (SELECT i, j, v - avg(v) OVER (PARTITION BY i) - avg(v) OVER (PARTITION BY j) + avg(v) OVER () AS v
    FROM products),
{_two_axes('centred')},
scores AS MATERIALIZED (SELECT a.i AS entity, a.x * sqrt(f.value) AS pc1, b.x * sqrt(s.value) AS pc2
    FROM first_axis a JOIN second_axis b ON a.i = b.i, first_value f, second_value s),
{_UPRIGHT}"""

# Covariance of the places of a vector; the centred vectors' products with its axes are the scores.
EMBEDDINGS_PLANE_SQL = f"""cells AS MATERIALIZED (SELECT vec_id AS entity, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x
    FROM embeddings),
off AS MATERIALIZED (SELECT entity, i, x - avg(x) OVER (PARTITION BY i) AS x FROM cells),
spread AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.x * b.x) AS v FROM off a JOIN off b ON a.entity = b.entity GROUP BY 1, 2),
{_two_axes('spread')},
scores AS MATERIALIZED (SELECT entity, sum(off.x * a.x) AS pc1, sum(off.x * b.x) AS pc2
    FROM off JOIN first_axis a ON off.i = a.i JOIN second_axis b ON off.i = b.i GROUP BY 1),
{_UPRIGHT}"""
