"""Readers of the outline alone: the same nodes without summaries and keywords, and without reading texts."""

from cartulary.operators import outline as O
from cartulary.plans.inputs import conversation_sections
from cartulary.plans.tree_queries import _titles

FOLDER = "/root/testdata/sf0.001"


def test_the_outline_is_that_of_the_whole_tree(spark):
    sections = conversation_sections(spark, FOLDER)
    titles = _titles(sections)
    whole = O.build_tree(sections, titles)
    alone = O.build_tree(sections, titles, digests=False)
    assert alone.dtypes == whole.dtypes
    told = ["summary", "keywords"]
    assert sorted(map(str, alone.drop(*told).collect())) == sorted(map(str, whole.drop(*told).collect()))
    assert alone.filter("summary is not null or keywords is not null").isEmpty()


def test_the_outline_alone_needs_no_texts(spark):
    sections = conversation_sections(spark, FOLDER).drop("text").selectExpr("*", "raise_error('read') as text")
    assert O.build_tree(sections, _titles(sections), digests=False).count() > 0
