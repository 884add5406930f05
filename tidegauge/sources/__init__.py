"""Readers for counter files, replay inputs and streams, and table sinks."""
