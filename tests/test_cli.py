"""The command line's arguments and the list of rules."""

import pytest

from sitewright import __main__ as cli
from sitewright.operators import rules as R


def test_reference_lists_every_rule():
    for form in ("text", "markdown"):
        listed = cli.reference(form)
        assert all(r.id in listed for r in R.registry())


def test_arguments():
    args = cli.parser().parse_args(["audit", "--pages", "p", "--sites", "s", "--out", "o", "--only", "health,seo"])
    assert args.only == ("seo", "health") and args.format == "html" and args.shown == 50
    args = cli.parser().parse_args(["crawl", "--web", "w", "--starts", "s", "--out", "o", "--exclude", "/a/**", "--exclude", "/b", "--max-depth", "0"])
    assert args.exclude == ["/a/**", "/b"] and (args.max_pages, args.max_depth, args.max_assets, args.delay) == (50, 0, 300, 1000)
    for wrong in (["crawl", "--web", "w", "--starts", "s", "--out", "o", "--max-pages", "2001"], ["audit"], ["audit", "--pages", "p", "--sites", "s", "--out", "o", "--only", "x"], ["audit", "--pages", "p", "--sites", "s", "--out", "o", "--shown", "0"], []):
        with pytest.raises(SystemExit) as e:
            cli.parser().parse_args(wrong)
        assert e.value.code == 2
