"""What a user asks for by one word: the tables of each command, over a data folder or over sources that follow the interface."""

from __future__ import annotations

import argparse
import importlib
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

MODULES = ["messages", "relations", "timeline", "network", "landscape", "mailing", "reports", "texts"]

#: The queries that each command puts together.
COMMANDS = {
    "status": ["index_summary", "relationship_score", "score_status_summary"],
    "scan": ["union_channels", "channel_activity", "interaction_kinds"],
    "contact": ["contact_lookup_fallback", "mail_history", "contact_topics"],
    "attention": ["attention_needed", "dormant_high_value"],
    "trip": ["trip_contacts", "location_search"],
    "import": ["import_counters", "import_outcomes", "merge_candidates"],
    "enrich": ["mail_history", "key_threads_topk", "contact_topics", "subject_samples", "monthly_counts", "discovered_addresses"],
    "index": ["contact_counters", "thread_rollup"],
    "stats": ["global_stats"],
    "search": ["contact_filter", "contact_search"],
    "top": ["top_contacts_frequency", "top_contacts_recency", "top_contacts_centrality", "top_contacts_total"],
    "reconnect": ["reconnection_candidates"],
    "one-way": ["one_way_contacts"],
    "graph-stats": ["graph_stats"],
    "graph-communities": ["community_rollup"],
    "graph-compute": ["contact_metrics", "graph_betweenness", "graph_communities"],
    "landscape": ["industry_rollup", "relationship_distribution", "ecosystem", "coverage_gaps", "investors_by_relevance"],
    "maintain": ["entry_duplicates", "merge_preview", "validation_issues", "registry_update", "broken_links"],
    "extract": ["document_entities", "entity_contact_match", "entity_drafts"],
    "tag": ["sender_tags", "tag_counts"],
    "gaps": ["unanswered_list", "waiting_list", "post_event_tops"],
    "groups": ["party_occurrences", "group_membership", "members_top", "member_classes", "connectors"],
    "senders": ["sender_classes", "sender_tops"],
    "analyze": ["direction_class", "frequency_tier", "domain_rollup", "contact_lists"],
    "cleanup": ["mailbox_categories"],
    "insights": ["insights"],
}


class Source(Protocol):
    """A source of interactions: its name, its rows over a span of days, and the contact that an identifier of it means."""

    name: str

    def interactions(self, spark: SparkSession, since: str, until: str) -> DataFrame: ...

    def contact(self, identifier: str) -> str | None: ...


def scan_sources(spark: SparkSession, sources: list[Source], since: str, until: str) -> DataFrame:
    """The interactions of all sources over one span of days, as one table."""
    from kinweave.sources.files import all_interactions

    return all_interactions({s.name: s.interactions(spark, since, until) for s in sources})


def run(spark: SparkSession, folder: str, command: str) -> dict[str, DataFrame]:
    """The tables of a command by the names of their queries; an unknown command is a KeyError."""
    queries = {k: q for m in MODULES for k, q in importlib.import_module(f"kinweave.queries.{m}").QUERIES.items()}
    return {name: queries[name](spark, folder) for name in COMMANDS[command]}


def main(args: list[str] | None = None) -> None:
    """kinweave.commands COMMAND FOLDER OUT: write a command's tables below OUT, as a report."""
    from kinweave.sources.sinks import write_report

    p = argparse.ArgumentParser(prog="kinweave.commands")
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("folder")
    p.add_argument("out")
    given = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    write_report(run(spark, given.folder, given.command), given.out)


if __name__ == "__main__":
    main()
