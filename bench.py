"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every query runs once for warm-up of the session at large (the first query) and once timed; results are written to the
no-op sink, so every row and column is computed.
"""

from __future__ import annotations

import json
import os
import time

from mailposture.plans import catalog
from mailposture.session import local_session

HEADLINE = """
    provider_share classify_domains attach_classification evidence_mx evidence_spf_include gateway_detect evidence_asn spf_ip_first_asn
    cname_chain combined_providers country_overview regional_providers confidence_histogram signal_combos signal_conflicts
    shared_domains build_mta domain_security attach_security merged_regional combined_security tls_modes run_evaluation
    operator_concentration export_provider_statistics export_confidence_statistics findings_summary mx_divergence regression_summary chi_square_provider
    classification_metrics guess_domains frequency_blocklist decide resolve_output latest_observation email_domains
    page_email_domains contact_links site_emails
""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), memory="20g")
    names = [n for n in HEADLINE if n in catalog.RUN]
    catalog.RUN[names[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        catalog.RUN[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
