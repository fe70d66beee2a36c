"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import checks
from .decontaminate import SQL as OP4_SQL
from .decontaminate import op4_benchmark_containment
from .html_text import op9_template_text
from .kneser_ney import op10_kneser_ney
from .pieces import op1_gumbel_segmentations
from .quality import op2_mcd_quality
from .quotes import op6_quotation_links
from .secrets import op8_secret_links
from .sharding import op5_histogram_shards
from .simhash import op7_simhash_components
from .url_rules import op3_mined_url_rules

QUERIES = {f.__name__: f for f in (op1_gumbel_segmentations, op2_mcd_quality, op3_mined_url_rules, op4_benchmark_containment, op5_histogram_shards, op6_quotation_links, op7_simhash_components, op8_secret_links, op9_template_text, op10_kneser_ney)} | checks.QUERIES
ORACLE_SQL: dict[str, str] = {"op4_benchmark_containment": OP4_SQL} | checks.ORACLE_SQL
