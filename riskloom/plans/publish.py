"""Send a split of a transaction table to the transactions topic, in the order of its senders."""

from __future__ import annotations

import argparse
from dataclasses import replace

from riskloom.plans.session import add_input_arguments, read_input, session
from riskloom.settings import Settings
from riskloom.sources.topics import publish


def main() -> None:
    parser = add_input_arguments(argparse.ArgumentParser(description=__doc__))
    settings = Settings.from_env()
    # The job's published flags.
    flags = {
        "--bootstrap": {"default": settings.kafka_bootstrap_servers},
        "--split": {"default": "test", "choices": ["train", "test", "all"]},
        "--max-events": {"type": int},
        "--dry-run": {"action": "store_true"},
    }
    for flag, options in flags.items():
        parser.add_argument(flag, **options)
    asked = parser.parse_args()

    rows = read_input(session("publish"), asked.input, asked.format)
    topic = replace(settings, kafka_bootstrap_servers=asked.bootstrap)
    figures = publish(rows, topic, asked.split, asked.max_events, asked.dry_run)
    messages = figures.pop("messages", None)
    if messages is not None:
        messages.show(truncate=False)
    print(", ".join(f"{name} {value:g}" for name, value in figures.items()))


if __name__ == "__main__":
    main()
