"""python -m arcweft check|fix|baseline [folder] [--home NAME]"""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import SparkSession

from arcweft import api
from arcweft.plans import report
from arcweft.plans.rulebooks import RuleConfigError, RulebookError, plural
from arcweft.sources.aliases import ConfigError
from arcweft.sources.store import is_address


def main(argv: list[str] | None = None) -> int:
    """Runs a command; 0 if clean, 1 with problems or an error. ARCWEFT_TRANSCRIPT=1 names styles instead of using them."""
    parser = argparse.ArgumentParser(prog="arcweft")
    parser.add_argument("command", choices=["check", "fix", "baseline"])
    parser.add_argument("folder", nargs="?", default=".", help="a local folder, or the address of one in a store")
    parser.add_argument("--home", default=api.HOME, help="folder of rules and baseline within the project")
    args = parser.parse_args(argv)
    transcript = os.environ.get("ARCWEFT_TRANSCRIPT") == "1"
    say = lambda style, text: report.say(style, text, transcript)
    began = time.time()
    project = args.folder if is_address(args.folder) else os.path.abspath(args.folder)
    say("Title", f"🚀 {dict(check='Checking', fix='Fixing', baseline='Baselining')[args.command]} project: {project}")
    if args.command == "fix":
        say("Plain", "Changelog:")
    spark = SparkSession.builder.appName("arcweft").getOrCreate()
    try:
        if args.command != "fix":
            for style, text in report.banner(api.rulebooks_at(spark, f"{project.rstrip('/')}/{args.home}/rules"), args.home):
                say(style, text)
        if args.command == "check":
            found, run = api.check(spark, project, args.home)
            if run.clean:
                say("Success", "✅ Success: No problems found.")
            else:
                say("Error", f"Found {plural(run.total, 'problem')}:")
                say("Error", report.DIVIDER)
                say("Error", report.BETWEEN.join(r.text for r in found.select("text").toLocalIterator()))
                say("Error", report.DIVIDER)
        elif args.command == "baseline":
            _, run = api.baseline(spark, project, args.home)
            say("Success", f"✅ Success: Baseline generated with {plural(run.total, 'problem')}.")
        else:
            changed, run = api.fix(spark, project, args.home)
            for path in changed:
                say("Change", f"  modified  {path}")
            say("Plain", report.DIVIDER)
            say("Success", report.fixed(run.auto_fixable))
            say("Plain", report.DIVIDER)
    except (RulebookError, RuleConfigError, ConfigError) as e:
        say("Error", f"❌ Error: {e}")
        return 1
    for path in run.unreadable:
        say("Error", f"❌ Error: {path}: not valid UTF-8")
    say("Plain", report.summary(run, time.time() - began))
    if not run.clean:
        say("Error", f"❌ Error: {report.found(run, 'arcweft')}")
    return 0 if run.clean else 1


if __name__ == "__main__":
    sys.exit(main())
