"""Measurement Set tables: schemas, creation with linked subtables, imaging columns."""

from __future__ import annotations

from typing import TYPE_CHECKING, Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rows import ROWID
from ..plans.binder import quoted
from ..types import TYPE_NAMES, TaqlError
from . import store
from .files import Files

if TYPE_CHECKING:
    from ..table import Table

#: Required columns as name:type, with [n] for a fixed shape and [kd] for any shape of k axes. Fixed values.
REQUIRED = {
    "MAIN": "UVW:double[3] FLAG:boolean[2d] FLAG_CATEGORY:boolean[3d] WEIGHT:float[1d] SIGMA:float[1d] ANTENNA1:int ANTENNA2:int ARRAY_ID:int DATA_DESC_ID:int EXPOSURE:double FEED1:int FEED2:int FIELD_ID:int FLAG_ROW:boolean INTERVAL:double OBSERVATION_ID:int PROCESSOR_ID:int SCAN_NUMBER:int STATE_ID:int TIME:double TIME_CENTROID:double",
    "ANTENNA": "OFFSET:double[3] POSITION:double[3] TYPE:string DISH_DIAMETER:double FLAG_ROW:boolean MOUNT:string NAME:string STATION:string",
    "DATA_DESCRIPTION": "FLAG_ROW:boolean POLARIZATION_ID:int SPECTRAL_WINDOW_ID:int",
    "DOPPLER": "DOPPLER_ID:int SOURCE_ID:int TRANSITION_ID:int VELDEF:double",
    "FEED": "POSITION:double[3] BEAM_OFFSET:double[2d] POLARIZATION_TYPE:string[1d] POL_RESPONSE:complex[2d] RECEPTOR_ANGLE:double[1d] ANTENNA_ID:int BEAM_ID:int FEED_ID:int INTERVAL:double NUM_RECEPTORS:int SPECTRAL_WINDOW_ID:int TIME:double",
    "FIELD": "DELAY_DIR:double[2d] PHASE_DIR:double[2d] REFERENCE_DIR:double[2d] CODE:string FLAG_ROW:boolean NAME:string NUM_POLY:int SOURCE_ID:int TIME:double",
    "FLAG_CMD": "APPLIED:boolean COMMAND:string INTERVAL:double LEVEL:int REASON:string SEVERITY:int TIME:double TYPE:string",
    "FREQ_OFFSET": "ANTENNA1:int ANTENNA2:int FEED_ID:int INTERVAL:double OFFSET:double SPECTRAL_WINDOW_ID:int TIME:double",
    "HISTORY": "APP_PARAMS:string[1d] CLI_COMMAND:string[1d] APPLICATION:string MESSAGE:string OBJECT_ID:int OBSERVATION_ID:int ORIGIN:string PRIORITY:string TIME:double",
    "OBSERVATION": "TIME_RANGE:double[2] LOG:string[1d] SCHEDULE:string[1d] FLAG_ROW:boolean OBSERVER:string PROJECT:string RELEASE_DATE:double SCHEDULE_TYPE:string TELESCOPE_NAME:string",
    "POINTING": "DIRECTION:double[2d] ANTENNA_ID:int INTERVAL:double NAME:string NUM_POLY:int TARGET:double[0d] TIME:double TIME_ORIGIN:double TRACKING:boolean",
    "POLARIZATION": "CORR_TYPE:int[1d] CORR_PRODUCT:int[2d] FLAG_ROW:boolean NUM_CORR:int",
    "PROCESSOR": "FLAG_ROW:boolean MODE_ID:int TYPE:string TYPE_ID:int SUB_TYPE:string",
    "SOURCE": "DIRECTION:double[2] PROPER_MOTION:double[2] CALIBRATION_GROUP:int CODE:string INTERVAL:double NAME:string NUM_LINES:int SOURCE_ID:int SPECTRAL_WINDOW_ID:int TIME:double",
    "SPECTRAL_WINDOW": "MEAS_FREQ_REF:int CHAN_FREQ:double[1d] REF_FREQUENCY:double CHAN_WIDTH:double[1d] EFFECTIVE_BW:double[1d] RESOLUTION:double[1d] FLAG_ROW:boolean FREQ_GROUP:int FREQ_GROUP_NAME:string IF_CONV_CHAIN:int NAME:string NET_SIDEBAND:int NUM_CHAN:int TOTAL_BANDWIDTH:double",
    "STATE": "CAL:double FLAG_ROW:boolean LOAD:double OBS_MODE:string REF:boolean SIG:boolean SUB_SCAN:int",
    "SYSCAL": "ANTENNA_ID:int FEED_ID:int INTERVAL:double SPECTRAL_WINDOW_ID:int TIME:double",
    "WEATHER": "ANTENNA_ID:int INTERVAL:double TIME:double",
}
#: Further columns of the complete descriptions; [0d] is an array of any number of axes. Fixed values.
OPTIONAL = {
    "MAIN": "ANTENNA3:int BASELINE_REF:boolean CORRECTED_DATA:complex[0d] DATA:complex[0d] FEED3:int FLOAT_DATA:float[0d] IMAGING_WEIGHT:float[0d] LAG_DATA:complex[0d] MODEL_DATA:complex[0d] PHASE_ID:int PULSAR_BIN:int PULSAR_GATE_ID:int SIGMA_SPECTRUM:float[0d] TIME_EXTRA_PREC:double UVW2:double[0d] VIDEO_POINT:complex[0d] WEIGHT_SPECTRUM:float[0d] CORRECTED_WEIGHT_SPECTRUM:float[0d]",
    "ANTENNA": "MEAN_ORBIT:double[0d] ORBIT_ID:int PHASED_ARRAY_ID:int",
    "DATA_DESCRIPTION": "LAG_ID:int",
    "FEED": "FOCUS_LENGTH:double PHASED_FEED_ID:int",
    "FIELD": "EPHEMERIS_ID:int",
    "POINTING": "ENCODER:double[0d] ON_SOURCE:boolean OVER_THE_TOP:boolean POINTING_MODEL_ID:int POINTING_OFFSET:double[0d] SOURCE_OFFSET:double[0d]",
    "PROCESSOR": "PASS_ID:int",
    "SOURCE": "POSITION:double[0d] PULSAR_ID:int REST_FREQUENCY:double[0d] SOURCE_MODEL:record SYSVEL:double[0d] TRANSITION:string[0d]",
    "SPECTRAL_WINDOW": "ASSOC_NATURE:string[0d] ASSOC_SPW_ID:int[0d] BBC_NO:int BBC_SIDEBAND:int DOPPLER_ID:int RECEIVER_ID:int",
}
#: Pairs of value and flag of the two calibration tables, and which values are arrays.
_FLAGGED = {"SYSCAL": ("PHASE_DIFF", "TANT", "TANT_TSYS", "TCAL", "TRX", "TSKY", "TSYS"), "WEATHER": ("DEW_POINT", "H2O", "IONOS_ELECTRON", "PRESSURE", "REL_HUMIDITY", "TEMPERATURE", "WIND_DIRECTION", "WIND_SPEED")}
_TIMES, _RAD2, _ITRF = {"QuantumUnits": ["s"], "MEASINFO": {"type": "epoch", "Ref": "UTC"}}, {"QuantumUnits": ["rad", "rad"], "MEASINFO": {"type": "direction", "Ref": "J2000"}}, ["m", "m", "m"]
#: Units and frames by column name, or by table and column where a name has two meanings. Fixed values.
KEYWORDS: dict[str, dict[str, Any]] = {
    **dict.fromkeys(("TIME", "TIME_CENTROID", "TIME_RANGE", "RELEASE_DATE", "TIME_ORIGIN"), _TIMES),
    **dict.fromkeys(("BEAM_OFFSET", "DELAY_DIR", "PHASE_DIR", "REFERENCE_DIR", "DIRECTION", "TARGET", "ENCODER", "POINTING_OFFSET", "SOURCE_OFFSET"), _RAD2),
    **dict.fromkeys(("INTERVAL", "EXPOSURE", "TIME_EXTRA_PREC"), {"QuantumUnits": ["s"]}),
    **dict.fromkeys(("OFFSET", "POSITION"), {"QuantumUnits": _ITRF, "MEASINFO": {"type": "position", "Ref": "ITRF"}}),
    **dict.fromkeys(("UVW", "UVW2"), {"QuantumUnits": _ITRF, "MEASINFO": {"type": "uvw", "Ref": "ITRF"}}),
    **dict.fromkeys(("CHAN_WIDTH", "EFFECTIVE_BW", "RESOLUTION", "TOTAL_BANDWIDTH", "CHAN_FREQ", "REF_FREQUENCY", "FREQ_OFFSET.OFFSET"), {"QuantumUnits": ["Hz"]}),
    **dict.fromkeys(("CAL", "LOAD", "TANT", "TCAL", "TRX", "TSKY", "TSYS", "DEW_POINT", "TEMPERATURE"), {"QuantumUnits": ["K"]}),
    **dict.fromkeys(("RECEPTOR_ANGLE", "PHASE_DIFF", "WIND_DIRECTION"), {"QuantumUnits": ["rad"]}),
    **dict.fromkeys(("DISH_DIAMETER", "FOCUS_LENGTH"), {"QuantumUnits": ["m"]}),
    **dict.fromkeys(("H2O", "IONOS_ELECTRON"), {"QuantumUnits": ["m-2"]}),
    "VELDEF": {"QuantumUnits": ["m/s"], "MEASINFO": {"type": "doppler", "Ref": "RADIO"}},
    "PROPER_MOTION": {"QuantumUnits": ["rad/s"]},
    "REST_FREQUENCY": {"QuantumUnits": ["Hz"], "MEASINFO": {"type": "frequency", "Ref": "LSRK"}},
    "SYSVEL": {"QuantumUnits": ["m/s"], "MEASINFO": {"type": "radialvelocity", "Ref": "LSRK"}},
    "PRESSURE": {"QuantumUnits": ["hPa"]}, "REL_HUMIDITY": {"QuantumUnits": ["%"]}, "WIND_SPEED": {"QuantumUnits": ["m/s"]},
}


def optional_columns(table: str) -> str:
    """The further columns of a table; those of the calibration tables come from their pairs."""
    out = OPTIONAL.get(table, "").split()
    for name in _FLAGGED.get(table, ()):
        array = table == "SYSCAL" and name != "PHASE_DIFF"
        out += [f"{name}:float{'[0d]' if array else ''}", f"{name}_FLAG:boolean"]
        if array:
            out.append(f"{name}_SPECTRUM:float[0d]")
    return " ".join(out)


def column_keywords(table: str, column: str) -> dict[str, Any]:
    """Units and frame of a column."""
    base = column.removesuffix("_SPECTRUM") if table == "SYSCAL" else column
    if base in ("TANT_TSYS",):
        return {}
    return KEYWORDS.get(f"{table}.{base}", KEYWORDS.get(base, {}))


#: Subtables that a new Measurement Set has.
LINKED = ("ANTENNA", "DATA_DESCRIPTION", "FEED", "FIELD", "FLAG_CMD", "HISTORY", "OBSERVATION", "POINTING", "POLARIZATION", "PROCESSOR", "SPECTRAL_WINDOW", "STATE")


def required_schema(table: str = "MAIN", complete: bool = False) -> T.StructType:
    """Schema of the required (or of all known) columns of MAIN or a subtable."""
    name = table.upper() or "MAIN"
    if name not in REQUIRED:
        raise TaqlError(f"no subtable {table}")
    fields = []
    for item in REQUIRED[name].split() + (optional_columns(name).split() if complete else []):
        column, _, kind = item.partition(":")
        base, _, shape = kind.rstrip("]").partition("[")
        element = TYPE_NAMES[base]
        meta: dict[str, Any] = {"valueType": base, "ndim": -1}
        if keywords := column_keywords(name, column):
            meta["keywords"] = keywords
        t: T.DataType = element
        if shape.endswith("d"):
            t, meta["ndim"] = store.variable(element), int(shape[:-1])
        elif shape:
            t, meta["ndim"], meta["shape"] = T.ArrayType(element), 1, [int(shape)]
        fields.append(T.StructField(column, t, True, meta))
    return T.StructType(fields)


def complete_schema(table: str = "MAIN") -> T.StructType:
    """Schema of all known columns."""
    return required_schema(table, True)


def _new(spark: SparkSession, path: str, schema: T.StructType, keywords: dict[str, Any]) -> None:
    own = {f.name: f.metadata["keywords"] for f in schema if f.metadata.get("keywords")}
    meta = {"keywords": keywords, "column_keywords": own, "columns": {f.name: f.metadata for f in schema}, "info": {}}
    store.save(spark, path, store.empty_rows(spark, schema, 0), meta)


def default_ms(spark: SparkSession, path: str, desc: dict[str, dict[str, Any]] | None = None, dminfo: Any = None) -> Table:
    """An empty Measurement Set with its linked subtables; desc adds columns to MAIN or replaces them."""
    from ..table import Table, schema_of

    path = store.clean(path)
    schema = required_schema()
    if desc:
        more = schema_of(desc)
        schema = T.StructType([*(f for f in schema if f.name not in more.names), *more])
    _new(spark, path, schema, {"MS_VERSION": 2.0} | {n: f"Table: {n}" for n in LINKED})
    for n in LINKED:
        _new(spark, f"{path}/{n}", required_schema(n), {})
    return Table(spark, path)


def default_ms_subtable(spark: SparkSession, name: str, path: str, desc: dict[str, dict[str, Any]] | None = None, dminfo: Any = None) -> Table:
    from ..table import Table, schema_of

    schema = required_schema(name)
    if desc:
        more = schema_of(desc)
        schema = T.StructType([*(f for f in schema if f.name not in more.names), *more])
    _new(spark, store.clean(path), schema, {})
    return Table(spark, store.clean(path))


IMAGING = ("MODEL_DATA", "CORRECTED_DATA", "IMAGING_WEIGHT")


def add_imaging_columns(table: Table) -> None:
    """Model and corrected data shaped like DATA (or FLOAT_DATA), and weights per channel; all zero.

    MODEL_DATA's keyword CHANNEL_SELECTION holds (0, channels) of each spectral window.
    """
    spark, path = table.spark, table.path
    if path is None:
        raise TaqlError("a view can't be written")
    df = table.df()
    data = next((c for c in ("DATA", "FLOAT_DATA") if c in df.columns), None)
    if data is None:
        raise TaqlError("no DATA or FLOAT_DATA column")
    element = TYPE_NAMES["complex"]
    t = df.schema[data].dataType
    meta = dict(df.schema[data].metadata or {}) | {"valueType": "complex"}
    zero = F.struct(F.lit(0.0).cast("float").alias("re"), F.lit(0.0).cast("float").alias("im"))
    if isinstance(t, T.ArrayType):
        cells = F.transform(quoted(data), lambda x: zero).cast(T.ArrayType(element))
        shape = meta.get("shape") or []
        channels = F.lit(int(shape[0])) if shape else F.size(quoted(data))
    else:
        like = quoted(data)
        cells = F.when(like.isNotNull(), F.struct(like["shape"].alias("shape"), F.transform(like["data"], lambda x: zero).alias("data"))).cast(store.variable(element))
        channels = F.coalesce(F.get(like["shape"], 0), F.lit(0))
    weights = F.array_repeat(F.lit(0.0).cast("float"), channels.cast("int"))
    for name in ("MODEL_DATA", "CORRECTED_DATA"):
        if name not in df.columns:
            df = df.withColumn(name, cells).withMetadata(name, meta)
    if "IMAGING_WEIGHT" not in df.columns:
        df = df.withColumn("IMAGING_WEIGHT", F.struct(F.array(channels.cast("int")).alias("shape"), weights.alias("data")))
        df = df.withMetadata("IMAGING_WEIGHT", {"valueType": "float", "ndim": 1})
    new = table.meta()
    window = f"{path}/SPECTRAL_WINDOW"
    counts = []
    if store.is_table(spark, window):  # one row per spectral window
        counts = [r[0] for r in store.load(spark, window).orderBy(ROWID).select("NUM_CHAN").collect()]
    new["column_keywords"].setdefault("MODEL_DATA", {})["CHANNEL_SELECTION"] = [[0, int(n)] for n in counts]
    store.save(spark, path, df, new)


def remove_imaging_columns(table: Table) -> None:
    gone = [c for c in IMAGING if c in table.colnames()]
    if gone:
        table.removecols(gone)
        table.flush()


def is_ms(spark: SparkSession, path: str) -> bool:
    return Files(spark).exists(f"{store.clean(path)}/ANTENNA/{store.META}")
