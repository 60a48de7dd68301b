"""Readers and writers of feeds, artefacts and live payloads."""
