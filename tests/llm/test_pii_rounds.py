from steadymap.llm import pii


def spans(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.s for r in pii.find(docs).select("doc_id", pii.written("spans").alias("s")).collect()}


def test_found_instances_support_new_patterns(spark):
    """Seeds, a first context, instances, a second context that no seed has, and a last instance."""
    texts = [f"Client IP: 10.{k // 200}.{k % 200}.7 and more" for k in range(300)]
    letters = "bcdfghjklmnpqrstvwxyz"
    first = [f"q{letters[k % 21]}-{1000 + k}-{'x' * (k % 3 + 1)}{letters[k // 2]}" for k in range(30)]
    texts += [f"Client IP: {v} here" for v in first] + [f"reached under {v} there" for v in first]
    texts += ["reached under 77zz-88-k then", "elsewhere 77zz-88-m then"]
    got = spans(spark, texts)
    assert all(got[300 + k] == f"ip:11:{11 + len(v)}" and got[330 + k] == f"ip:14:{14 + len(v)}" for k, v in enumerate(first))
    assert got[360] == "ip:14:23" and got[361] == ""


def test_addresses_with_few_digits_are_found_after_sure_words(spark):
    """What a context reveals needs no four digits: host-only and spelled-out e-mail addresses, short ip addresses."""
    texts = [f"Email: u{k}.x@example{k}.org and more" for k in range(300)] + [f"Client IP: 10.{k // 200}.{k % 200}.7 and more" for k in range(300)]
    texts += ["Email: jane.doe@intranet", "Email: jane(at)example.org, then", "Client IP: fe80::1", "Client IP: ::1 here"]
    # other words, other forms and other contexts stay alone
    texts += ["Email: nobody", "Client IP: home", "at noon jane.doe@intranet", "ratio 1:2:3 now", "Email: 1:2:3", "Client IP: joe@home"]
    got = spans(spark, texts)
    found = [[texts[n][int(s.split(":")[1]) : int(s.split(":")[2])] for s in got[n].split(",") if s] for n in range(600, len(texts))]
    assert found[:4] == [["jane.doe@intranet"], ["jane(at)example.org"], ["fe80::1"], ["::1"]]
    assert found[4:6] == [[], []] and found[7:] == [[], [], []]
    # a value that is known stays known wherever it stands
    assert found[6] == ["jane.doe@intranet"] and got[600].startswith("email:") and got[602].startswith("ip:")
