"""Queries through the segment store hold a bounded number of files."""

from __future__ import annotations

import os

import pytest

from segline import catalog, catalog_documents
from segline.sources import segment_store

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["s2_stored_files", "s2_chosen_files", "s2_init_files", "s5_stored_boxes"])
def test_a_store_holds_some_files_at_a_time(spark, monkeypatch, name):
    whole = sorted(map(tuple, catalog.QUERIES[name](spark, SF).collect()), key=str)
    roots, counts, drop = [], [], segment_store.drop_channels

    def counted(spark, root):
        top = root.removeprefix("file://")
        roots.append(top)
        counts.append(len([f for _, _, files in os.walk(top) for f in files]))
        drop(spark, root)

    monkeypatch.setattr(segment_store, "drop_channels", counted)
    monkeypatch.setattr(catalog_documents, "STORED", 100)
    got = sorted(map(tuple, catalog.QUERIES[name](spark, SF).collect()), key=str)
    assert got == whole and len(counts) > 2 and max(counts) < sum(counts) / 2 and not any(map(os.path.exists, roots))


def test_turns_are_small_spread_over_tasks_and_few_at_a_time(spark, monkeypatch):
    """Files of at most STORES stores stand at the same time, a store is written by several tasks and a scan lists it once."""
    monkeypatch.setattr(catalog_documents, "STORED", 200)
    live, most, parts, lists = set(), [0], [], []
    write, drop, scan = segment_store.write_segment_store, segment_store.drop_channels, segment_store.scan_segment_store

    def written(files, root):
        live.add(root)
        most[0] = max(most[0], len(live))
        parts.append(files.rdd.getNumPartitions())
        write(files, root)

    def dropped(spark, root):
        drop(spark, root)
        live.remove(root)

    def scanned(spark, root, **options):
        found = scan(spark, root, **options)
        lists.append((found.rdd.getNumPartitions(), len(os.listdir(root.removeprefix("file://")))))
        return found

    for name, by in (("write_segment_store", written), ("drop_channels", dropped), ("scan_segment_store", scanned)):
        monkeypatch.setattr(segment_store, name, by)
    assert catalog.QUERIES["s2_stored_files"](spark, SF).count() and not live
    assert 1 <= most[0] <= catalog_documents.STORES and min(parts) >= 4 and max(n for n, _ in lists) <= catalog_documents.ONE_TASK["groups"]
