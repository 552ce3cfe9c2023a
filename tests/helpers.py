from pyspark.sql import functions as F


def jobs(spark, payloads, source="src", ids=None, labels=None):
    rows = [((ids[i] if ids else f"j{i}"), source, p, None, labels or {}) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "id string, source string, payload string, correlation_key string, "
                                       "labels map<string,string>")


def ran(df, spec):
    return [r.ran for r in df.select(F.array_join(F.filter(F.array(*[
        F.when(F.col("steps")[s.id].isNotNull(), F.lit(s.id)) for s in spec.steps]),
        lambda x: x.isNotNull()), ",").alias("ran")).collect()]
