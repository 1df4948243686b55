"""The operators as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from cloakframe.llm.centroids import OP11_SQL, op11_centroids
from cloakframe.llm.collocations import OP12_SQL, op12_collocations
from cloakframe.llm.decontamination import OP3_SQL, op3_decontamination
from cloakframe.llm.disclosure import op5_personal_data
from cloakframe.llm.licenses import OP9_SQL, op9_licenses
from cloakframe.llm.line_dedup import OP7_SQL, op7_line_dedup
from cloakframe.llm.maxent import op13_lm_scores
from cloakframe.llm.near_duplicates import op2_near_duplicates
from cloakframe.llm.neighbours import op8_nearest
from cloakframe.llm.packing import op4_packing
from cloakframe.llm.quality import op6_quality
from cloakframe.llm.secrets import op1_secrets
from cloakframe.llm.toxicity import op10_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_secrets, op2_near_duplicates, op3_decontamination, op4_packing, op5_personal_data, op6_quality,
        op7_line_dedup, op8_nearest, op9_licenses, op10_toxicity, op11_centroids, op12_collocations, op13_lm_scores)
} | {"pipeline": corpus_pipeline.run}
ORACLES: dict[str, str] = {
    "op3_decontamination": OP3_SQL, "op7_line_dedup": OP7_SQL, "op9_licenses": OP9_SQL,
    "op11_centroids": OP11_SQL, "op12_collocations": OP12_SQL,
}
