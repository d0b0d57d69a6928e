"""tag_and_denormalize: a row for each tag whose criterion a row meets, as one native generator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.errors import ScriptError
from weftline.functions.compile import Compiler, fields

#: Criteria in one array expression; more are joined from several, which keeps generated code small.
CHUNK = 100


def tagged(df: DataFrame, types: dict[str, str], tag: str, criteria: dict[str, str]) -> DataFrame:
    """df with the string column p__<tag>; rows that meet no criterion go."""
    if not criteria:
        raise ScriptError("there are no tag criteria")
    compiler, made = Compiler(fields("r", types)), []
    for name, text in criteria.items():
        met = compiler(text)
        if met.kind != "bool":
            raise ScriptError(f"the criterion of tag {name} is {met.kind}, not bool")
        made.append(F.when(met.column, F.lit(name)))
    arrays = [F.array_compact(F.array(*made[i : i + CHUNK])) for i in range(0, len(made), CHUNK)]
    return df.withColumn(f"p__{tag}", F.explode(F.concat(*arrays)))
