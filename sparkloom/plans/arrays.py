"""Whole-array plans: write a field as encoded chunks and read it back.

    write: chunk -> statistics -> candidates -> predict -> mask -> cost -> best -> encode
    read:  decode -> place -> field

One shuffle brings a chunk's values together; all that follows is narrow but for joins on chunk ids.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dimensions import ALGORITHMS, HOST_CODECS, POLICIES, config32
from ..functions.scalar import action_name, heuristic_algorithm
from ..operators import chunking, codec, quality, select, stats
from ..operators.predict import Weights, predict

CHUNK_KEYS = ["field_id", "chunk_id"]


@dataclass(frozen=True)
class Options:
    """How a field is written.

    ``selector``: ``model`` (network and cost), ``heuristic`` (byte entropy), ``exhaustive`` (try all) or an
    algorithm's name.  ``mode``: ``release`` encodes, ``bypass`` stores raw chunks, ``trace`` also returns all
    candidates.  A lossless request (``error_bound`` 0) never gets a quantised configuration, in any mode.
    """

    selector: str = "model"
    policy: str = "balanced"
    error_bound: float = 0.0
    min_psnr: float = 0.0
    chunk: int = 65536
    shuffle: bool = False
    mode: str = "release"
    bandwidth: float = 5e6
    time_floor_ms: float = 1.0
    host_only: bool = True

    def weights(self) -> tuple[float, float, float]:
        known = {p: w for p, *w in POLICIES}
        if self.policy not in known:
            raise ValueError(f"unknown policy {self.policy}; one of {sorted(known)}")
        return tuple(known[self.policy])


def _algorithm(algo_idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in ALGORITHMS[1:]]), algo_idx + 1)


def chunk_table(field: DataFrame, chunk: int) -> DataFrame:
    """``field_id, chunk_id, values, n_bytes`` and statistics: one row a chunk."""
    arrays = codec.chunk_arrays(chunking.chunk_1d(field, chunk))
    return stats.array_features(arrays).withColumn("n_bytes", F.col("n") * 4)


def candidates(table: DataFrame, options: Options, weights: Weights) -> DataFrame:
    """Predicted and priced candidates of every chunk, masked by bound and quality."""
    configs = select.mask_lossless(config32(table.sparkSession), options.error_bound)
    if options.host_only:
        configs = configs.where(_algorithm(F.col("algo_idx")).isin(*HOST_CODECS))
    rows = select.candidates(table.drop("values"), configs).withColumn("error_bound", F.lit(float(options.error_bound)))
    p = predict(rows, weights).withColumns({"ct": F.col("pred_comp_ms"), "dt": F.col("pred_decomp_ms"), "ratio": F.col("pred_ratio"), "psnr": F.col("pred_psnr")})
    return select.with_cost(select.mask_psnr(p, options.min_psnr), *options.weights(), bandwidth=options.bandwidth, time_floor_ms=options.time_floor_ms)


def infer(table: DataFrame, options: Options, weights: Weights) -> DataFrame:
    """``field_id, chunk_id, action32, comp_algo, shuffle, quant`` that the options choose for every chunk."""
    if options.selector == "heuristic":
        return table.select(*CHUNK_KEYS, F.lit(None).cast("int").alias("action32"), heuristic_algorithm(F.col("entropy")).alias("comp_algo"), F.lit(0).alias("shuffle"), F.lit(0).alias("quant"))
    if options.selector == "model":
        best = select.best(candidates(table, options, weights), CHUNK_KEYS, ["algo_idx", "shuffle", "quant"])
    elif options.selector == "exhaustive":
        best = select.best(measure(table, options), CHUNK_KEYS, ["algo_idx", "shuffle", "quant"], by="encoded_bytes")
    elif options.selector in ALGORITHMS[1:]:
        idx, quant = ALGORITHMS.index(options.selector) - 1, int(options.error_bound > 0)
        best = table.select(*CHUNK_KEYS, F.lit(idx + 8 * quant + 16 * options.shuffle).alias("action32"), F.lit(idx).alias("algo_idx"), F.lit(int(options.shuffle)).alias("shuffle"), F.lit(quant).alias("quant"))
    else:
        raise ValueError(f"unknown selector {options.selector}")
    return best.select(*CHUNK_KEYS, "action32", _algorithm(F.col("algo_idx")).alias("comp_algo"), "shuffle", "quant")


def measure(table: DataFrame, options: Options) -> DataFrame:
    """Encoded size of every chunk under every allowed configuration with a host codec."""
    configs = select.mask_lossless(config32(table.sparkSession), options.error_bound).withColumn("comp_algo", _algorithm(F.col("algo_idx"))).where(F.col("comp_algo").isin(*HOST_CODECS))
    rows = table.select(*CHUNK_KEYS, "values").crossJoin(F.broadcast(configs)).withColumn("error_bound", F.when(F.col("quant") == 1, F.lit(float(options.error_bound))).otherwise(0.0))
    enc = codec.encode(rows, [*CHUNK_KEYS, "action32", "algo_idx", "quant"])
    return enc.select(*CHUNK_KEYS, "action32", "algo_idx", "quant", "shuffle", "original_bytes", F.octet_length("encoded").alias("encoded_bytes"))


def write_field(field: DataFrame, options: Options, weights: Weights) -> DataFrame:
    """``field_id, chunk_id, action32, name, encoded, original_bytes, encoded_bytes, passed_through``.

    A chunk whose encoding is not smaller, or whose algorithm has no codec here, is stored raw; the reader
    tells by the magic.
    """
    table = chunk_table(field, options.chunk)
    if options.mode == "bypass":
        plan = table.select(*CHUNK_KEYS, F.lit(-1).alias("action32"), F.lit("none").alias("comp_algo"), F.lit(0).alias("shuffle"), F.lit(0).alias("quant"))
    else:
        plan = infer(table, options, weights)
    rows = table.select(*CHUNK_KEYS, "values").join(plan, CHUNK_KEYS).withColumn("error_bound", F.when(F.col("quant") == 1, F.lit(float(options.error_bound))).otherwise(0.0))
    enc = codec.encode_or_raw(rows, [*CHUNK_KEYS, "action32"])
    return enc.select(*CHUNK_KEYS, "action32", F.coalesce(action_name(F.col("action32")), F.col("comp_algo")).alias("name"), "encoded", "original_bytes", F.octet_length("encoded").alias("encoded_bytes"), (~codec.is_encoded(F.col("encoded"))).alias("passed_through"))


def read_field(encoded: DataFrame, chunk: int) -> DataFrame:
    """``field_id, idx, value`` of encoded chunks."""
    rows = codec.decode(encoded, CHUNK_KEYS)
    return rows.select("field_id", "chunk_id", F.posexplode("values").alias("pos", "value")).select("field_id", (F.col("chunk_id") * chunk + F.col("pos")).alias("idx"), "value")


def verify(field: DataFrame, back: DataFrame, bound: float) -> DataFrame:
    """Mismatches, violations of the bound and largest error by field; a lost or extra value is a mismatch."""
    pairs = field.select("field_id", "idx", F.col("value").alias("original")).join(back.select("field_id", "idx", F.col("value").alias("restored")), ["field_id", "idx"], "full")
    lost = pairs.groupBy("field_id").agg(F.count_if(F.col("original").isNull() | F.col("restored").isNull()).alias("lost"))
    return quality.mismatches(pairs.where("original is not null and restored is not null"), ["field_id"], F.lit(bound)).join(lost, "field_id")


def profile_ranking(table: DataFrame, options: Options, weights: Weights) -> DataFrame:
    """Predicted and measured order of candidates by size, for tau and top-1 regret: ``pred_cost, real_cost`` by action."""
    predicted = candidates(table, options, weights).select(*CHUNK_KEYS, "action32", F.col("cost").alias("pred_cost"))
    measured = measure(table, options).select(*CHUNK_KEYS, "action32", (F.col("encoded_bytes") / options.bandwidth).alias("real_cost"))
    return predicted.join(measured, [*CHUNK_KEYS, "action32"], "left")
