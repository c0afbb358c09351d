"""What a mail is: predicates over headers, subject and message as columns, and the cascade that gives every mail its type.

Mails are rows (id, email, subject, user_agent, mailer, patchwork_hint, stable_header, lists,
recipients, message, is_patch, in_project, depth); addresses and subjects are in lower case.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Addresses, phrases and header values by which automatic mails and processes are known.
BOTS = [
    "tip-bot2@linutronix.de", "tipbot@zytor.com", "noreply@ciplatform.org", "patchwork@emeril.freedesktop.org",
    "pr-tracker-bot@kernel.org", "bot+bpf-ci@kernel.org", "sashiko-bot@kernel.org", "bot@kernelci.org",
]
POTENTIAL_BOTS = ["broonie@kernel.org", "lkp@intel.com"]
PROCESSES = ["linux-next", "git pull", "rfc", "[pull]"]
MERGER, MERGE_LIST = "akpm@linux-foundation.org", "mm-commits@vger.kernel.org"
NEXT_LIST, NEXT_ADDRESS, NEXT_AUTHOR = "linux-next", "linux-next@vger.kernel.org", "sfr@canb.auug.org.au"
STABLE_LIST, STABLE_ADDRESS, STABLE_QUEUE = "stable", "stable@vger.kernel.org", "LinuxStableQueue"
STABLE_PHRASES = ["review patch", "upstream commit", "the patch below does not apply to the"]
COVER = r"(?i)^\[.*patch.*\s0+/.*\].*"
ADDED = r'^patch ".*" added to .*'
COMMIT_UPSTREAM = r"(?s)^.*commit\s+.+\s+upstream.*"
GENERAL, GENERAL_PREFIX = "THE REST", "General Project Administration"

PATCH, OTHER, NOT_FIRST, PROCESS, NOT_PROJECT, BOT, NEXT, STABLE = "patch", "other", "not-first", "process", "not-project", "bot", "linux-next", "stable-review"
#: Distances that stand for a missing side.
NO_COMMITTER, NO_PATCH, NEITHER, UNREACHABLE = 9996, 9997, 9998, 99999


@dataclass(frozen=True)
class Profile:
    """What differs between projects: root directories and files, whether linux-next and stable reviews exist."""

    dirs: tuple[str, ...] = ()
    files: tuple[str, ...] = ()
    kernel: bool = True


def header(value: Column) -> Column:
    """A header in lower case on one line; empty where there is none."""
    return F.coalesce(F.translate(F.lower(value), "\t\n", " "), F.lit(""))


def is_next(lists: Column, recipients: Column) -> Column:
    return F.coalesce(F.array_contains(lists, NEXT_LIST) | F.array_contains(recipients, NEXT_ADDRESS), F.lit(False))


def is_bot(email: Column, subject: Column, user_agent: Column, mailer: Column, hint: Column, lists: Column, next_: Column) -> Column:
    """A mail that a program wrote."""
    email, subject, user_agent, mailer, hint = (header(c) for c in (email, subject, user_agent, mailer, hint))
    rules = [
        email.isin(BOTS),
        email.isin(POTENTIAL_BOTS) & ((hint == "ignore") | subject.startswith("applied")),
        subject.rlike(ADDED),
        subject.contains("[git commit]"),
        (email == MERGER) & (user_agent.contains("s-nail") | subject.contains("[merged]") | F.coalesce(F.array_contains(lists, MERGE_LIST), F.lit(False))),
        email.contains("syzbot") & email.contains("syzkaller.appspotmail.com"),
        mailer == "tip-git-log-daemon",
        next_ & email.contains(NEXT_AUTHOR),
        email.contains("noreply@github.com"),
        email.startswith("patchwork-bot+"),
        subject.contains("[autobuild.buildroot.net] daily results"),
        subject.contains("oe-core cve metrics"),
    ]
    return reduce(lambda a, b: a | b, rules)


def is_cover_letter(is_patch: Column, subject: Column) -> Column:
    return ~is_patch & F.coalesce(subject.rlike(COVER), F.lit(False))


def is_process(subject: Column) -> Column:
    return reduce(lambda a, b: a | b, [header(subject).contains(p) for p in PROCESSES])


def is_first(is_patch: Column, depth: Column) -> Column:
    """A patch that begins a thread or answers the mail that does."""
    return is_patch & (depth <= 1)


def is_stable_review(mailer: Column, stable_header: Column, lists: Column, recipients: Column, message: Column) -> Column:
    sent = F.array_contains(lists, STABLE_LIST) | F.array_contains(recipients, STABLE_ADDRESS)
    low = F.lower(F.coalesce(message, F.lit("")))
    said = reduce(lambda a, b: a | b, [low.contains(p) for p in STABLE_PHRASES]) | low.rlike(COMMIT_UPSTREAM)
    return F.coalesce(mailer.contains(STABLE_QUEUE), F.lit(False)) | F.lower(F.coalesce(stable_header, F.lit(""))).isin("commit", "review") | F.coalesce(sent & said, F.lit(False))


def mail_type(is_patch: Column, first: Column, process: Column, in_project: Column, bot: Column, next_: Column, stable: Column) -> Column:
    """The type of a mail; of several that hold the one named first here counts.

    Stable reviews are patches only. Bots and linux-next mails may be no patches. A patch to which nothing else applies is one.
    """
    return (
        F.when(is_patch & stable, STABLE).when(next_ & ~bot, NEXT).when(bot, BOT).when(is_patch & ~in_project, NOT_PROJECT).when(is_patch & process, PROCESS)
        .when(is_patch & ~first, NOT_FIRST).when(is_patch, PATCH).otherwise(OTHER)
    )


def characterise(mails: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """Mails with cover_letter, first_in_thread, process, bot, next, stable and type."""
    c = F.col
    yes = lambda x: F.coalesce(x, F.lit(False))
    next_ = is_next(c("lists"), c("recipients")) if profile.kernel else F.lit(False)
    stable = is_stable_review(c("mailer"), c("stable_header"), c("lists"), c("recipients"), c("message")) if profile.kernel else F.lit(False)
    out = mails.withColumn("cover_letter", is_cover_letter(c("is_patch"), c("subject"))).withColumn("first_in_thread", is_first(c("is_patch"), c("depth"))).withColumn("process", yes(is_process(c("subject"))))
    out = out.withColumn("next", next_).withColumn("stable", stable)
    out = out.withColumn("bot", is_bot(c("email"), c("subject"), c("user_agent"), c("mailer"), c("patchwork_hint"), c("lists"), c("next")))
    return out.withColumn("type", mail_type(c("is_patch"), c("first_in_thread"), c("process"), yes(c("in_project")), c("bot"), c("next"), c("stable")))


def without_general(sections: DataFrame) -> DataFrame:
    """Sections but for those that hold everything."""
    return sections.filter((F.col("section") != GENERAL) & ~F.col("section").startswith(GENERAL_PREFIX))


def list_matches(lists_of_sections: Column, list_: Column) -> Column:
    """Whether one of the sections of a patch names the list; NULL where the patch has no section."""
    return F.when(F.size(lists_of_sections) > 0, F.exists(lists_of_sections, lambda x: F.array_contains(x, list_)))


def committer_correct(commits: DataFrame, people: DataFrame, tasks: int | None = None) -> DataFrame:
    """(commit, correct): name or mail of the committer is that of a person of a section of the commit.

    commits: (commit, committer, committer_mail, section), a row per section or one with a NULL; people: (section, name, mail).
    With `tasks` commits are dealt to so many tasks, which a caller who knows their number can let grow with it.
    """
    who = people.select("section", F.explode(F.array(F.nullif("name", F.lit("")), F.nullif("mail", F.lit("")))).alias("who")).filter("who is not null").distinct()
    asked = commits.select("commit", "section", F.explode(F.array("committer", "committer_mail")).alias("who"))
    marked = asked.join(who.withColumn("hit", F.lit(True)), ["section", "who"], "left").select("commit", F.coalesce("hit", F.lit(False)).alias("hit"))
    if tasks:
        marked = marked.repartition(tasks, "commit")
    return marked.groupBy("commit").agg(F.bool_or("hit").alias("correct"))


def committer_near(commits: DataFrame, people: DataFrame, groups: DataFrame, tasks: int | None = None) -> DataFrame:
    """(commit, near): the committer is correct, or a person of any section in the community (section, group) of one of the commit's."""
    wider = people.join(groups, "section").select(F.concat(F.lit("group "), "group").alias("section"), "name", "mail")
    asked = commits.join(groups, "section").select("commit", "committer", "committer_mail", F.concat(F.lit("group "), "group").alias("section"))
    both = commits.select("commit", "committer", "committer_mail", "section").unionByName(asked)
    return committer_correct(both, people.select("section", "name", "mail").unionByName(wider), tasks).withColumnRenamed("correct", "near")


def committer_distance(correct: Column, n_patch: Column, n_committer: Column, hops: Column) -> Column:
    """0 for a correct committer; a sentinel where a side has no sections; hops between the sections, or UNREACHABLE."""
    return (
        F.when(correct, 0).when((n_patch == 0) & (n_committer == 0), NEITHER).when(n_patch == 0, NO_PATCH).when(n_committer == 0, NO_COMMITTER).otherwise(F.coalesce(hops, F.lit(UNREACHABLE))).cast("int")
    )


def ignored(mails: DataFrame, members: DataFrame) -> DataFrame:
    """(id, ignored, related): patches that nobody else answered and that never came upstream, NULL for other mails.

    mails: (id, type, foreign_response); members: (id, cluster_id, is_upstream). `related` asks that
    no relevant patch of the cluster was answered either. A mail without a cluster is one by itself.
    """
    label = mails.join(members.select("id", "cluster_id"), "id", "left")
    alone = F.struct(F.col("cluster_id").alias("c"), F.when(F.col("cluster_id").isNull(), F.col("id")).alias("own"))
    label = label.withColumn("_c", alone)
    up = members.groupBy("cluster_id").agg(F.bool_or("is_upstream").alias("up"))
    quiet = label.filter(F.col("type") == PATCH).groupBy("_c").agg(F.bool_and(~F.coalesce("foreign_response", F.lit(False))).alias("quiet"))
    rows = label.join(up, "cluster_id", "left").join(quiet, "_c", "left")
    never = ~F.coalesce("up", F.lit(False)) & ~F.coalesce("foreign_response", F.lit(False))
    relevant = F.col("type") == PATCH
    return rows.select("id", F.when(relevant, never).alias("ignored"), F.when(relevant, never & F.col("quiet")).alias("related"))


def off_list(members: DataFrame, types: DataFrame, dates: DataFrame) -> DataFrame:
    """(cluster_id, commit, n_up, n_down): clusters of one or two commits without a downstream mail that a person sent, by their first commit.

    types: (id, type) of mails; dates: (id, date) of commits.
    """
    irrelevant = [BOT, NEXT, STABLE, PROCESS]
    m = members.join(types, "id", "left").join(dates, "id", "left")
    g = m.groupBy("cluster_id").agg(
        F.count_if("is_upstream").alias("n_up"), F.count_if(~F.col("is_upstream")).alias("n_down"),
        F.count_if(~F.col("is_upstream") & ~F.coalesce(F.col("type"), F.lit(BOT)).isin(irrelevant)).alias("relevant"),
        F.min(F.when(F.col("is_upstream"), F.struct("date", "id"))).alias("first"),
    )
    return g.filter("n_up between 1 and 2 and relevant = 0").select("cluster_id", F.col("first.id").alias("commit"), "n_up", "n_down")
