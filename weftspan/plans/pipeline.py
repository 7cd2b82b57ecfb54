"""Stripe calling from contacts to the final table; each stage is a DataFrame that is made when first asked for."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from weftspan.functions.lineage import cut
from weftspan.operators import features, graph, refine, stripes
from weftspan.sources.bedpe import read_contacts


@dataclass(frozen=True)
class Params:
    """Parameters of stripe calling; the defaults are part of the semantics."""

    fix_bin_start: bool = True
    skiprows: int = -1
    petcount_col: int = -1
    data_bin_size: int = 5000
    max_fan_cluster_gap: int = 15000
    max_loop_cluster_gap: int = 15000
    min_stripe_length: int = 20000
    max_stripe_length: int = -1
    n_quantile_levels: int = 50
    stripe_gap_threshold: float = 0.0
    stripe_score_holder_exponent: float = 2.0
    merge_stripes_threshold: int = 0
    max_merged_stripe_width: int = 80000
    compat: str = "reference"


class Call:
    """One run of the caller. Stages that two or more steps read are written to the shared folder once, the others not."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, params: Params):
        self.nodes, self.edges, self.params = nodes, edges, params

    @cached_property
    def blades(self) -> DataFrame:
        return cut(stripes.blades(self.nodes, self.edges))

    @cached_property
    def clustered(self) -> DataFrame:
        return cut(stripes.cluster_blades(self.blades, self.params.max_fan_cluster_gap, self.params.max_loop_cluster_gap))

    @cached_property
    def loop_clusters(self) -> DataFrame:
        found = stripes.loop_clusters(self.clustered)
        return cut(features.lengths_and_gaps(found.join(stripes.number_stripes(found), stripes.CLUSTER)))

    @cached_property
    def links(self) -> DataFrame:
        return stripes.orthogonal_links(self.clustered, self.loop_clusters)

    @cached_property
    def knots(self) -> DataFrame:
        return features.quantile_knots(self.loop_clusters, self.params.n_quantile_levels)

    @cached_property
    def scored(self) -> DataFrame:
        p = self.params
        rows = features.running_scores(features.gap_scores(self.loop_clusters, self.knots), p.stripe_score_holder_exponent)
        return cut(features.cross_scores(rows, self.links, p.compat))

    @cached_property
    def trimmed(self) -> DataFrame:
        p = self.params
        return refine.trim(self.scored, p.min_stripe_length, None if p.max_stripe_length == -1 else p.max_stripe_length, p.stripe_gap_threshold)

    @cached_property
    def filtered(self) -> DataFrame:
        """One row for each stripe that passes."""
        return cut(refine.filter_stripes(refine.summarise(self.trimmed), min_length=self.params.min_stripe_length))

    @cached_property
    def merged(self) -> DataFrame:
        """Loop clusters of the final stripes."""
        p = self.params
        runs = refine.merge_runs(self.filtered, p.merge_stripes_threshold, p.max_merged_stripe_width, compat=p.compat)
        return refine.merge(self.trimmed, runs)

    @cached_property
    def raw(self) -> DataFrame:
        """The result table of all stripes before trimming."""
        return refine.result(refine.summarise(self.scored))

    @cached_property
    def final(self) -> DataFrame:
        return refine.result(refine.summarise(self.merged))


class StripeCaller:
    """Calls stripes on a path of contacts, a table of interactions, or a pair (nodes, edges)."""

    def __init__(self, params: Params | None = None):
        self.params = params or Params()

    def start(self, source: str | DataFrame | tuple[DataFrame, DataFrame], spark: SparkSession | None = None) -> Call:
        p = self.params
        if isinstance(source, tuple):
            return Call(*source, p)
        if isinstance(source, str):
            source = read_contacts(spark or SparkSession.active(), source, skiprows=p.skiprows, petcount_col=p.petcount_col)
        return Call(*graph.build(graph.prepare(source, p.data_bin_size, p.fix_bin_start)), p)

    def raw_pipeline(self, source, spark: SparkSession | None = None) -> DataFrame:
        return self.start(source, spark).raw

    def full_pipeline(self, source, spark: SparkSession | None = None) -> DataFrame:
        return self.start(source, spark).final
