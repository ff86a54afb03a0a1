"""Result sentences of the engines, as printf templates."""

COST = {
    "missing": "Project cost (expenditure/sanctioned) is zero or missing; cost anomaly cannot be assessed.",
    "few": "Insufficient peer data for sector '%s' (found %d peers; minimum %d required). Neutral score assigned.",
    "early": "Expenditure (₹%,.0f) is low (%.1f%% of peer median ₹%,.0f), but consistent with early project phase '%s'.",
    "low": "Unusually low expenditure (₹%,.0f is only %.1f%% of peer median ₹%,.0f, deviation: %.1f%%). "
           "Potential token booking, incomplete reporting, or ghost asset risk.",
    "over_peer": "Severe cost overrun (%.1f%%) combined with peer anomaly. Expenditure (₹%,.0f) exceeds sanctioned limit (₹%,.0f) "
                 "and is %.1f× peer median (%dth percentile).",
    "over": "Cost overrun detected (%.1f%%): expenditure (₹%,.0f) exceeds approved sanctioned budget (₹%,.0f) by ₹%,.0f.",
    "normal": "Project expenditure (₹%,.0f) is normal and well-aligned with %s peer median (₹%,.0f, percentile: %dth).",
    "legitimate": "Project expenditure (₹%,.0f) is %.1f× peer median, but is strictly within the approved sanctioned budget (₹%,.0f) "
                  "with zero cost overrun. Legitimate approved scale.",
    "outlier": "Project cost (₹%,.0f) is an anomaly (%.1f× peer median ₹%,.0f, %dth percentile in sector '%s', robust Z-score: %.1f).",
}
DELAY = {
    "not_applicable": "Project status is '%s'; schedule delay risk is not applicable.",
    "closed": "Project status is '%s'; closed without recorded completion date.",
    "no_plan": "Planned completion date is not recorded in official records; delay cannot be determined.",
    "late": "Completed project finished %d days behind scheduled completion date (%s). Actual completion: %s.",
    "late_pct": " (+%.0f%% schedule overrun)",
    "early": "Completed on schedule (%d days ahead of expected completion date).",
    "exact": "Completed exactly on schedule on the expected completion date.",
    "undated": "Project is recorded as completed; actual completion date is not documented to verify slippage.",
    "overdue": "Ongoing project is %d days overdue beyond planned completion date (%s as of %s).",
    "overdue_pct": " Schedule overrun: +%.0f%%.",
    "today": "Project is on schedule within contractual timeline (due today on target completion date %s).",
    "on_time": "Project is on schedule within contractual timeline (%d days remaining until target completion %s).",
}
MISMATCH = {
    "not_applicable": "Project status is '%s'; progress mismatch risk is not applicable.",
    "both": "Neither financial expenditure nor physical milestone data is available for this project; requires verification.",
    "financial": "Financial expenditure records are not documented; financial-physical gap cannot be determined.",
    "physical": "Physical progress milestones have not been reported yet; progress mismatch cannot be assessed.",
    "aligned": "Physical delivery (%s) and financial expenditure (%s) are perfectly aligned (gap of 0.0 points).",
    "balanced": "Physical delivery (%s) and financial expenditure (%s) are well aligned within governance tolerance (gap of %+.1f points).",
    "ahead": "Significant financial/physical gap: recorded financial progress (%s) leads verified physical progress (%s) by +%.1f percentage points. "
             "Potential reporting inconsistency or premature drawdown; requires verification.",
    "behind": "Significant financial/physical gap: physical progress (%s) is reported %.1f percentage points ahead of recorded expenditure (%s). "
              "Potential contractor payment backlog or delayed measurement entry; requires verification.",
}
DUPLICATE = {
    "short": "Project description is empty or too short for reliable duplicate detection.",
    "no_pool": "No other projects with sufficient text found in corpus for duplicate comparison.",
    "none": "No duplicate or suspiciously similar project descriptions detected (highest semantic match: %d%% with project '%s').",
    "below": "No duplicate or suspiciously similar project descriptions detected.",
    "template": "Wording overlap (%d%%) with project '%s' reflects standard sectoral phrasing across different states (%s vs %s), not a duplicate work.",
    "possible": "Possible duplicate: Notable semantic similarity (%d%% match, adjusted: %d%%) to project '%s' in %s.",
    "strong_local": "High duplicate risk: Project description is highly similar (%d%% match) to '%s' located in the same %s. "
                    "Potential redundant proposal or double-billing risk.",
    "strong": "Potential duplicate proposal: High semantic similarity (%d%% match) with project '%s' in %s.",
}
AGENCY = {
    "none": "No recorded implementing agency; pattern analysis cannot be conducted.",
    "few": "Insufficient historical project history for agency '%s' (%d project(s) analyzed; minimum threshold is %d); "
           "historical agency pattern cannot be reliably established.",
    "limited": "Preliminary agency track record for '%s' indicates moderate variance across %d historical projects (%d delayed [%.1f%%], "
               "%d progress gaps [%.1f%%]); limited sample size prevents strong institutional conclusions and is distinguished from current "
               "individual project delivery performance.",
    "critical": "Historical agency track record for '%s' indicates chronic delivery bottlenecks across %d historical projects (%d delayed [%.1f%%], "
                "%d progress gaps [%.1f%%], %d cost anomalies [%.1f%%]); indicates systemic execution constraints requiring district-level "
                "administrative review.",
    "high": "Historical agency track record for '%s' exhibits elevated schedule delay frequency across %d historical projects (%d delayed [%.1f%%], "
            "%d progress gaps [%.1f%%], %d cost anomalies [%.1f%%]); indicates recurring delivery friction requiring operational monitoring.",
    "medium": "Historical agency track record for '%s' shows moderate variance across %d historical projects (%d delayed [%.1f%%], "
              "%d cost anomalies [%.1f%%], %d progress gaps [%.1f%%]); distinguished from current individual project delivery performance.",
    "low": "Agency '%s' exhibits a consistent historical execution track record across %d analyzed projects (%d completed [%.1f%%], "
           "%d delayed [%.1f%%], %d cost anomalies) within normal governance parameters.",
}
FUNDS = {
    "missing": "Financial accounting record not found for this project; risk cannot be evaluated.",
    "no_sanction": "No sanctioned allocation recorded for project; utilization score not applicable.",
    "over": "Reported expenditure exceeds sanctioned amount by %.1f%% (INR %,.2f budget overrun)",
    "deficit": "Reported expenditure exceeds released funds by INR %,.2f (%.1f%% above released tranche)",
    "closed_low": "Completed project shows only %.0f%% fund utilization (INR %,.2f remaining unspent without closure surrender)",
    "active_low": "Only %.0f%% of sanctioned funds have been utilized on active work",
    "prework": "Pre-construction stage; zero expenditure is expected prior to work commencement.",
    "healthy": "Healthy fund utilization (%.0f%% of sanctioned allocation absorbed)",
    "moderate": "Moderate fund utilization (%.0f%% absorbed)",
}
CAUTIOUS = {
    ("cost_anomaly", "high"): "Potential anomaly: sanctioned cost significantly deviates from category peer median%s; requires verification against "
                              "standard schedule of rates.",
    ("cost_anomaly", "mid"): "Moderate cost deviation observed relative to peer category benchmarks.",
    ("duplicate_detection", "high"): "Possible duplicate: high semantic description similarity%s with project %s; requires scope and site verification.",
    ("duplicate_detection", "mid"): "Moderate textual similarity identified with project %s; requires verification.",
    ("delay_detection", "high"): "Significant deviation in execution timeline: project overdue%s; requires schedule review.",
    ("delay_detection", "mid"): "Moderate timeline slippage observed (%s days overdue).",
    ("progress_mismatch", "high"): "Unusual pattern: significant gap between financial disbursements and physical milestone progress%s; requires verification.",
    ("progress_mismatch", "mid"): "Moderate divergence observed between financial expenditure and recorded physical progress%s.",
    ("agency_pattern", "high"): "Unusual pattern in historical performance for %s across %s analyzed projects%s; requires institutional review.",
    ("agency_pattern", "mid"): "Moderate historical risk pattern noted across %s projects handled by agency.",
}
SUMMARY = {
    "LOW": "Project exhibits low overall risk (score %.1f/100, tier: %s). All evaluated financial, timeline, scope, and institutional metrics "
           "are within expected parameters.",
    "MEDIUM": "Project exhibits medium overall risk (score %.1f/100, tier: %s) with notable contributions from %s. Routine operational verification "
              "is advised to maintain project trajectory.",
    "HIGH": "Project exhibits high overall risk (score %.1f/100, tier: %s) with primary contributions from %s. Identified potential anomalies "
            "warrant formal inspection before further milestone sign-off.",
    "CRITICAL": "Project exhibits critical overall risk (score %.1f/100, tier: %s) driven primarily by %s. Multiple indicators show significant "
                "deviations and unusual patterns that require immediate administrative verification.",
}
REVIEW = {
    "cost_anomaly": "Conduct an independent engineering estimate and bill-of-quantities (BOQ) review against the standard schedule of rates to "
                    "verify cost reasonableness.",
    "duplicate_detection": "Perform physical site inspection and geo-coordinate verification to confirm project scope is fully distinct from %s.",
    "delay_detection": "Review contractor milestone schedules and site progress logs%s to determine root causes and assess formal extension approvals.",
    "progress_mismatch": "Cross-reference physical measurement book (MB) recordings and site inspection certificates with released financial "
                         "disbursements to reconcile progress gaps.",
    "agency_pattern": "Examine overall active project workload, past completion rates, and staffing capacity of %s.",
}
