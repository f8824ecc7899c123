"""Composed jobs: risk modules and assessments, carriers, source quality, session activity."""
