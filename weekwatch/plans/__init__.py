"""The three jobs: validate, clean, detect. Only here are results written."""
