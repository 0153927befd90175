"""Metadata checks: tensor descriptors, model capabilities, dataset, checkpoint and benchmark records."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Element types with their bytes, layouts, and devices; error codes are the names raised below.
DTYPES = {"float32": 4, "float16": 2, "bfloat16": 2, "int8": 1, "uint8": 1, "int32": 4, "int64": 8}
LAYOUTS = ("RowMajor", "NCHW", "NHWC", "OHWI", "Strided")
RANK_FOUR = ("NCHW", "NHWC", "OHWI")
HOST_DEVICES = ("cpu-scalar", "cpu-threaded", "cpu-simd")
GPU_DEVICES = ("metal", "vulkan", "cuda", "webgpu")

DESCRIPTOR = "shape array<long>, strides array<long>, dtype string, layout string, device string, ownership string"
CAPABILITY = "model_id string, task string, dtypes array<string>, devices array<string>, max_rank long, max_input_bytes long, supports_inference boolean, supports_training boolean"


class ContractError(ValueError):
    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code


def dtype_size(dtype: Column | str) -> Column:
    c, out = F.col(dtype) if isinstance(dtype, str) else dtype, None
    for name, size in DTYPES.items():
        out = F.when(c == name, size) if out is None else out.when(c == name, size)
    return out


def element_count(shape: Column | str) -> Column:
    """The product of a shape; overflow raises."""
    return F.aggregate(F.col(shape) if isinstance(shape, str) else shape, F.lit(1).cast("long"), lambda s, x: s * x)


def byte_size() -> Column:
    return element_count("shape") * dtype_size("dtype")


def contiguous() -> Column:
    """Row-major strides; no strides mean contiguous unless the layout is strided."""
    step = F.aggregate(
        F.reverse(F.arrays_zip(F.col("shape").alias("n"), F.col("strides").alias("s"))),
        F.struct(F.lit(1).cast("long").alias("want"), F.lit(True).alias("ok")),
        lambda a, x: F.struct((a["want"] * x["n"]).alias("want"), (a["ok"] & (x["s"] == a["want"])).alias("ok")),
        lambda a: a["ok"],
    )
    return F.when(F.size("strides") == 0, F.col("layout") != "Strided").when(F.size("strides") != F.size("shape"), False).otherwise(step)


def descriptor_problem() -> Column:
    """The code of the first failing check of a descriptor, or null."""
    # The product in doubles tells an overflow without raising one.
    size = F.aggregate(F.transform("shape", lambda n: n.cast("double")), F.lit(1.0), lambda s, x: s * x) * dtype_size("dtype")
    checks = [
        (F.col("shape").isNull() | (F.size("shape") == 0) | F.exists("shape", lambda n: n <= 0), "InvalidShape"),
        (dtype_size("dtype").isNull(), "UnsupportedDataType"),
        (size >= 2.0**63, "ShapeOverflow"),
        (F.when(F.size("strides") > 0, F.size("strides") != F.size("shape")).otherwise(F.col("layout") == "Strided"), "InvalidStride"),
        ((F.col("ownership") == "DeviceOwned") & ~F.coalesce(F.col("device").isin(*GPU_DEVICES), F.lit(False)), "UnsupportedDevice"),
        (~F.coalesce(F.col("layout").isin(*LAYOUTS), F.lit(False)) | (F.col("layout").isin(*RANK_FOUR) & (F.size("shape") != 4)), "UnsupportedLayout"),
    ]
    return F.coalesce(*[F.when(bad, code) for bad, code in checks])


def describe(df: DataFrame) -> DataFrame:
    """Descriptors with their problem and, if there is none, elements, bytes and contiguity."""
    fine = F.col("problem").isNull()
    return df.withColumn("problem", descriptor_problem()).withColumns({"elements": F.when(fine, element_count("shape")), "bytes": F.when(fine, byte_size()), "contiguous": F.when(fine, contiguous())})


class Registry:
    """Model capabilities by unique id."""

    def __init__(self, spark: SparkSession):
        self.table = spark.createDataFrame([], CAPABILITY)

    def register(self, models: DataFrame) -> Registry:
        """Adds complete records; one that is incomplete, repeated or known is an error and adds nothing."""
        new = models.select(self.table.columns)
        whole = F.expr("model_id <> '' AND task IS NOT NULL AND size(dtypes) > 0 AND size(devices) > 0 AND max_rank > 0 AND max_input_bytes > 0 AND (supports_inference OR supports_training)")
        if new.where(~F.coalesce(whole, F.lit(False))).limit(1).count():
            raise ValueError("a capability record is incomplete")
        twice = new.groupBy("model_id").count().where("count > 1").limit(1).count()
        if twice or new.join(self.table, "model_id", "left_semi").limit(1).count():
            raise ContractError("DuplicateCapability")
        self.table = self.table.unionByName(new)
        return self

    def require(self, model_id: str) -> dict:
        rows = self.table.where(F.col("model_id") == model_id).limit(1).collect()
        if not rows:
            raise ContractError("CapabilityNotFound", model_id)
        return rows[0].asDict()

    def matching(self, task: str, dtype: str, device: str, training: bool = False, rank: int = 1, nbytes: int = 0) -> DataFrame:
        able = F.col("supports_training") if training else F.col("supports_inference")
        return self.table.where((F.col("task") == task) & able & (F.col("max_rank") >= rank) & (F.col("max_input_bytes") >= nbytes) & F.array_contains("dtypes", dtype) & F.array_contains("devices", device))

    def select(self, task: str, dtype: str, device: str, training: bool = False, rank: int = 1, nbytes: int = 0) -> dict:
        rows = self.matching(task, dtype, device, training, rank, nbytes).orderBy("model_id").limit(1).collect()
        if not rows:
            raise ContractError("CapabilityNotFound")
        return rows[0].asDict()


def check_descriptor(spark: SparkSession, descriptor: tuple) -> None:
    problem = spark.createDataFrame([descriptor], DESCRIPTOR).select(descriptor_problem().alias("p")).first()["p"]
    if problem:
        raise ContractError(problem)


def validate_dataset_format(spark: SparkSession, fmt: dict) -> None:
    """fmt: version, identifier, sample_count, samples and, if there are any, labels (descriptors as tuples)."""
    if fmt.get("version") != 1 or not fmt.get("identifier") or not fmt.get("sample_count", 0) > 0:
        raise ContractError("IncompatibleFormat")
    for part in (fmt["samples"], fmt.get("labels")):
        if part is not None:
            check_descriptor(spark, part)
            if part[0][0] != fmt["sample_count"]:
                raise ContractError("InvalidShape", "the first dimension is not the number of samples")


def validate_checkpoint_format(fmt: dict) -> None:
    if fmt.get("version") != 1 or not fmt.get("includes_parameters"):
        raise ContractError("IncompatibleFormat")


def validate_benchmark(report: dict) -> None:
    m, r = report.get("manifest", {}), report.get("metrics", {})
    if report.get("schema_version") != 1 or not all(m.get(k) for k in ("run_id", "benchmark", "compiler", "platform")):
        raise ValueError("the manifest is incomplete")
    if not r or any(not isinstance(v, (int, float)) or not math.isfinite(v) or v < 0 for v in r.values()):
        raise ValueError("a metric is missing, negative or not finite")
