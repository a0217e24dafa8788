"""Notices as they stand in files, against a plain search of all stretches of words."""

import math

import pytest

from logloom.llm.license_scan import TEMPLATES, scan

from . import brute

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal"
BSD = " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that"
GPL = "# You should have received a copy of the GNU General Public License\n# along with this program.  If not, see"
APACHE = "You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required"
CC = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
FILLER = "\n".join(f"some other words of line {i} in the file" for i in range(50))
NOTICES = {
    1: (f"{FILLER}\n{MIT}\n{FILLER}", "mit"),
    2: (f"{BSD}\n{FILLER}", "bsd"),
    3: (f"{FILLER}\n{GPL}", "gpl-3"),
    4: (APACHE, "apache-2"),
    5: (CC.format(""), "cc-by"),
    6: (CC.format("-NonCommercial"), "cc-by-nc"),
    7: (CC.format("-\nShareAlike"), "cc-by-sa"),
    8: (CC.format(" Non-Commercial"), "cc-by-nc"),
    9: ("Released under the Apache License", ""),
    10: (f"{CC.format('-NonCommercial')}\n{FILLER}\n{CC.format('')}", "cc-by,cc-by-nc"),
    11: ("Released under\nthe MIT\nLicense", "mit"),
    12: (f"{MIT.split()[0]} {FILLER} {MIT.partition(' ')[2][60:]}", ""),
    13: ("", ""),
    14: (None, ""),
}


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(k, t) for k, (t, _) in NOTICES.items()], "doc_id bigint, text string")
    return {r["doc_id"]: r for r in scan(docs).collect()}


def test_labels_of_wrapped_notices(found):
    assert {k: r["labels"] for k, r in found.items()} == {k: labels for k, (_, labels) in NOTICES.items()}


def test_scores_of_wrapped_notices(found):
    for key, template in ((1, "mit"), (2, "bsd"), (3, "gpl-3"), (4, "apache-2")):
        listed = next(brute.words(t) for label, t in TEMPLATES if label == template and set(brute.words(t)) <= set(brute.words(NOTICES[key][0])))
        w, span = brute.words(NOTICES[key][0]), math.ceil(len(listed) / 0.8)
        most = max(len(set(w[i : i + span]) & set(listed)) / len(set(listed)) for i in range(len(w)))
        assert abs(found[key]["score"] - most) < 1e-9
    assert found[9]["score"] == 0.0
