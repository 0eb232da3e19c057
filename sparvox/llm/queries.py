"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from .common import clear_stored  # noqa: F401 (for those who run the queries)
from .hpylm import op2_hpylm
from .licenses import OP8_SQL, op8_licenses
from .linededup import OP3_SQL, op3_line_dedup
from .media import op4_media
from .mixing import OP6_SQL, op6_mix
from .packing import op10_pack
from .quality import op5_quality
from .rules import op7_rules
from .sharding import op9_shard
from .simhash import op1_simhash


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_simhash, op2_hpylm, op3_line_dedup, op4_media, op5_quality, op6_mix, op7_rules, op8_licenses, op9_shard, op10_pack, pipeline)}
SQL = {"op3_line_dedup": OP3_SQL, "op6_mix": OP6_SQL, "op8_licenses": OP8_SQL}
