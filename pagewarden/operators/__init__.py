"""pagewarden.operators"""
