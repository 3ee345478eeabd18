"""Skill evidence and course/job gap analysis as Spark DataFrame operators."""
