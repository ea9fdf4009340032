"""Table schemas."""

from pyspark.sql import types as T

_S, _D, _L, _I, _B = (
    T.StringType(),
    T.DoubleType(),
    T.LongType(),
    T.IntegerType(),
    T.BooleanType(),
)


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# Identity, configuration and metric columns of the flat catalog, in order.
IDENTITY_COLUMNS = ("id", "status", "equation", "solver", "created_at", "parent_id", "error")
CONFIG_COLUMNS = ("viscosity", "grid_size", "dt", "steps", "seed")
METRIC_COLUMNS = (
    "initial_energy",
    "final_energy",
    "max_divergence",
    "mass_drift",
    "reynolds",
    "needs_review",
    "energy_increase_observed",
)
DOCUMENT_COLUMNS = ("config_json", "provenance_json", "metrics_json")

CATALOG = _struct(
    **dict.fromkeys(IDENTITY_COLUMNS, _S),
    viscosity=_D,
    grid_size=_L,
    dt=_D,
    steps=_L,
    seed=_L,
    initial_energy=_D,
    final_energy=_D,
    max_divergence=_D,
    mass_drift=_D,
    reynolds=_D,
    needs_review=_B,
    energy_increase_observed=_B,
    **dict.fromkeys(DOCUMENT_COLUMNS, _S),
)

CONFIG = _struct(
    equation=_S,
    viscosity=_D,
    grid_size=_L,
    dt=_D,
    steps=_L,
    save_every=_L,
    seed=_L,
    domain_length=_D,
    amplitude=_D,
    initial_condition=_S,
    contrast=_D,
)

ERROR = _struct(type=_S, message=_S)

# A run document. Metrics and provenance stay JSON text until a query names the entries.
RECORD = _struct(
    schema_version=_L,
    id=_S,
    created_at=_S,
    parent_id=_S,
    attempt=_L,
    equation=_S,
    solver=_S,
    config=CONFIG,
    provenance=T.MapType(_S, _S),
    status=_S,
    metrics=T.MapType(_S, _S),
    error=ERROR,
    storage_mode=_S,
    runtime_seconds=_D,
    solver_metadata=T.MapType(_S, _S),
)

FRAMES = _struct(
    run_id=_S, field=_S, frame=_I, time=_D, ny=_I, nx=_I, values=T.ArrayType(_D)
)
DIAGNOSTICS = _struct(run_id=_S, frame=_I, time=_D, name=_S, value=_D)
COORDS = _struct(run_id=_S, axis=_S, idx=_I, value=_D)
MANIFEST = _struct(version=_L, algorithm=_S, artifacts=T.MapType(_S, _S))
EVENT_LOG = _struct(time=_S, stage=_S, status=_S, detail=_S)
JOB_EVENTS = _struct(
    job_id=_S,
    sequence=_L,
    kind=_S,
    at=_D,
    token=_S,
    lease_seconds=_D,
    result_id=_S,
    error=_S,
)
