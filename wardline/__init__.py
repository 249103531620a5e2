"""Text guardrails as Spark jobs: admission, scoring, policies, result reuse, gating and monitoring."""
