"""From matchers to boolean columns."""
